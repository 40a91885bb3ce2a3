"""Language identification: known words first, shorter and shorter character n-grams for the rest.

A word of the model adds its log frequency in each language. A word that the model does not have is cut into
n-grams of the greatest length of which the model knows at least one; their mean log frequency counts. If it knows
none, the next shorter length is tried; a word without any known letter counts for nothing.

The model is fitted on a bounded sample of the labelled documents (``per_language``), and keeps a bounded number of
words and n-grams; everything else reads all documents. A text that is null, empty or without letters gets ``und``
and score 0, and so does every text if there is nothing to learn from. Equal scores go to the first language by code
point. Repeated rows get the same answer. Null doc_ids are neither learned from nor held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Scratch, map_columns, slices, sources

#: Documents learned from per language, about; words; n-grams of each length; greatest length.
PER_LANGUAGE, WORDS, GRAMS, LONGEST = 3000, 60_000, 40_000, 5
#: Added to every count.
SMOOTH = 0.5
#: Words whose scores a worker keeps.
CACHE = 200_000
UNKNOWN = "und"

letters = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> list[str]:
    return letters(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word between marks of its ends; the word itself where it is shorter."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language, in the order of languages."""

    languages: list[str]
    words: dict[str, tuple[float, ...]] = field(default_factory=dict)
    grams: dict[int, dict[str, tuple[float, ...]]] = field(default_factory=dict)

    def vector(self, word: str) -> tuple[float, ...] | None:
        found = self.words.get(word)
        if found is not None:
            return found
        for n in sorted(self.grams, reverse=True):
            table = self.grams[n]
            hits = [table[g] for g in grams(word, n) if g in table]
            if hits:
                return hits[0] if len(hits) == 1 else tuple(sum(x) / len(hits) for x in zip(*hits))
        return None


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.n = model, len(model.languages)
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, self.n))

    def score(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        if not found or not self.n:
            return UNKNOWN, 0.0
        place = self.place
        if len(place) > CACHE:
            self.reset()
            place = self.place
        at = [place.get(w, -1) for w in found]
        if -1 in at:
            for k, p in enumerate(at):
                if p < 0:
                    at[k] = self._add(found[k])
        total = self.table[at].sum(axis=0)
        best = int(total.argmax())
        return self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())

    def _add(self, word: str) -> int:
        at = self.place.get(word)
        if at is None:
            at = self.place[word] = len(self.place)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            vector = self.model.vector(word)
            if vector is not None:
                self.table[at] = vector
        return at


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, n, unit, count: words (n = 0), added up within the task as far as memory allows, and the n-grams of each."""
    seen: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for (lang, word), c in seen.items():
            counts[lang, 0, word] += c
            for n in range(1, LONGEST + 1):
                for g in grams(word, n):
                    counts[lang, n, g] += c
        seen.clear()
        keys = list(counts)
        for k in range(0, len(keys), 100_000):
            part = keys[k : k + 100_000]
            columns = [pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.int32()), pa.array([x[2] for x in part], pa.string()), pa.array([counts[x] for x in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "n", "unit", "count"])

    for batch in slices(batches, 64):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, c in Counter(words(text)).items():
                seen[lang, word] += c
        if len(seen) > 100_000:
            yield from out()
    if seen:
        yield from out()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, n_words: int = WORDS, n_grams: int = GRAMS) -> Model:
    """Learn from documents with a language that are not held out: about per_language of each, drawn by a digest."""
    spark = docs.sparkSession
    known = sources(docs, "doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([])
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)
    sample = known.where(drawn).select("lang", "text")
    counts = sample.mapInArrow(_counted, "lang string, n int, unit string, count long").groupBy("lang", "n", "unit").agg(F.sum("count").alias("count"))
    counts = Scratch(spark, "langid").save(counts, "counts")
    totals = {(r["lang"], r["n"]): r["s"] for r in counts.groupBy("lang", "n").agg(F.sum("count").alias("s")).collect()}
    languages = sorted({lang for lang, _ in totals})
    if not languages:
        return Model([])
    model = Model(languages)
    for n in range(LONGEST + 1):
        size = F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(totals.get((lang, n), 1)))])
        own = [F.sum(F.when(F.col("lang") == lang, F.col("count")).otherwise(0)).alias(f"c{k}") for k, lang in enumerate(languages)]
        units = counts.where(F.col("n") == n).groupBy("unit").agg(F.max(F.col("count") / F.element_at(size, F.col("lang"))).alias("top"), F.sum("count").alias("all"), *own)
        kept = units.where("all > 1").orderBy(F.desc("top"), "unit").limit(n_words if n == 0 else n_grams).drop("top", "all").toPandas()
        base = [math.log(SMOOTH / (totals.get((lang, n), 0) + SMOOTH * (len(kept) + 1))) for lang in languages]
        scores = np.array(base) + np.log1p(kept[[f"c{k}" for k in range(len(languages))]].to_numpy(float) / SMOOTH)
        table = dict(zip(kept["unit"], map(tuple, scores.tolist())))
        if n == 0:
            model.words = table
        elif table:
            model.grams[n] = table
    return model


def predict(docs: DataFrame, model: Model, added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs and the two added ones, which replace columns of their name."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = sources(docs, *[c for c in docs.columns if c.lower() not in {a.lower() for a in added}])
    place = docs.columns.index("text")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            got = [scorer.score(t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*names, *added])

    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])
    return map_columns(docs, run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, with a model fitted on its own labelled documents."""
    model = fit(docs)
    return predict(sources(docs, "doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
