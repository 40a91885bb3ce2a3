"""Line dedup by a log-template tree.

Each line is cut into tokens at ASCII white space; a token with a digit counts as a variable field. The tree has a
fixed depth: its first level is the token count, the next ``DEPTH`` are the leading tokens. In a leaf a token is
constant at its place if ``LEAST`` lines of different texts have it there, and a variable field otherwise. The line's
template is its constants and fields; a template recurs if ``LEAST`` lines of different texts have it, ``SHARE`` of
its tokens without digits are constant and so are half of all its tokens. Lines of recurring templates are dropped from every document but the first that has them
(the least doc_id), so that what a template says is not lost with its last copy.

A line that is repeated byte for byte needs no template: from ``EXACT`` characters on (without outer white space) it is
dropped from every document but the first as soon as two different texts have it. Shorter lines, and lines that are
alike in their tokens alone, need the support of a template.

Exact copies of a whole text count once towards recurrence. Support is added up over different lines, never gathered
by leaf, so that a line or leaf of a third of all documents is no burden to one task. Lines without tokens stay. Null
and empty texts stay as they are. Among null doc_ids nothing is the first; their lines go if another document has
them. Rows that share a doc_id are treated alike. Lines end at \\n alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, bit_filter, fresh, in_filter, map_columns, slices, sources, words_of

DEPTH, LEAST, SHARE = 3, 8, 0.8
#: Fewest characters of a line that goes as an exact copy; what counts as white space around it.
EXACT, SPACE = 20, " \t\n\x0b\x0c\r"
FIELD = "<*>"
_digit = re.compile(r"\d").search


def tokens_of(line: str) -> list[str]:
    """The line's tokens with a field for each that has a digit."""
    found = words_of(line)
    if _digit(line):
        found = [FIELD if _digit(w) else w for w in found]
    return found


def leaf_of(tokens: list[str]) -> str:
    return xxhash.xxh3_128_hexdigest("\x00".join([str(len(tokens)), *tokens[:DEPTH]]).encode())


def line_of(tokens: list[str]) -> str:
    return xxhash.xxh3_128_hexdigest("\x00".join(tokens).encode())


def copy_of(line: str) -> str:
    return hashlib.md5(line.encode()).hexdigest()


def text_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        leaves, texts = [], []
        for text in batch.column(0).to_pylist():
            own = {leaf_of(t) for t in map(tokens_of, (text or "").split("\n")) if t}
            leaves.extend(own)
            texts.extend([text_of(text or "")] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.string()), pa.array(texts, pa.int64())], ["leaf", "text"])


def _lines(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = {}
                for tokens in map(tokens_of, (text or "").split("\n")):
                    if tokens and in_filter(bits, leaf := leaf_of(tokens)):
                        lines[line_of(tokens)] = (leaf, tokens)
                for line, (leaf, tokens) in lines.items():
                    hashed = [xxhash.xxh32_intdigest(t.encode()) - (1 << 31) if t != FIELD else None for t in tokens]
                    out.append((doc_id, text_of(text), leaf, line, hashed))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "text", "leaf", "line", "tokens"])

    return run


def _copies(bits: np.ndarray, exact: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, lines = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {c for x in set((text or "").split("\n")) if len(x) >= exact and len(x.strip(SPACE)) >= exact and in_filter(bits, c := copy_of(x))}
                lines.extend(own)
                ids.extend([doc_id] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(bytes.fromhex, lines), pa.binary())], ["doc_id", "copy"])

    return run


def _edit(place: int, drop: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, totals, gone = [], [], []
            for text, lines in zip(batch.column(place).to_pylist(), batch.column(drop).to_pylist()):
                every = text.split("\n") if text else []
                kept, out = every, set(lines or ())
                if out:
                    kept = [x for x in every if not (t := tokens_of(x)) or (line_of(t) not in out and copy_of(x) not in out)]
                texts.append("\n".join(kept) if text is not None else None)
                totals.append(len(every))
                gone.append(len(every) - len(kept))
            columns = [pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(batch.columns) if k != drop]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], names)

    return run


def copied(docs: DataFrame, kept: Scratch, exact: int = EXACT) -> DataFrame:
    """doc_id, line: the lines (by digest) that each document has from another text and is not the first to have."""
    every = sources(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text"), F.explode(F.split("text", "\n")).alias("line"))
    every = every.where(F.length(F.trim("line", F.lit(SPACE))) >= exact).select("doc_id", "text", F.unhex(F.md5("line")).alias("copy"))
    # Two different texts have a line if the least and the greatest digest of its texts differ.
    found = every.groupBy("copy").agg(F.min("text").alias("one"), F.max("text").alias("other"), F.min("doc_id").alias("first"))
    found = kept.save(found.where("one <> other").select("copy", "first"), "copies")
    bits = bit_filter(found.select(F.hex("copy").alias("key")))
    held = sources(docs, "doc_id", "text").mapInArrow(_copies(bits, exact), "doc_id long, copy binary")
    later = held.join(found.hint("merge"), "copy").where("not (doc_id <=> first)")
    return later.select("doc_id", F.lower(F.hex("copy")).alias("line"))


def recurring(docs: DataFrame, kept: Scratch, least: int = LEAST, share: float = SHARE, exact: int = EXACT) -> DataFrame:
    """doc_id, lines: the lines (by hash) that each document loses; documents that lose none are absent."""
    leaves = sources(docs, "text").mapInArrow(_leaves, "leaf string, text long").distinct()
    leaves = kept.save(leaves.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("leaf"), "leaves")
    bits = bit_filter(leaves.select(F.col("leaf").alias("key")))
    lines = sources(docs, "doc_id", "text").mapInArrow(_lines(bits), "doc_id long, text long, leaf string, line string, tokens array<int>")
    lines = kept.save(lines.join(leaves.hint("merge"), "leaf", "left_semi"), "lines")
    # How many different texts have each different line; a line's leaf and tokens follow from it.
    support = lines.select("line", "text").distinct().groupBy("line").agg(F.count("*").alias("n"))
    forms = lines.groupBy("line").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"))
    forms = kept.save(forms.join(support.hint("merge"), "line"), "forms")
    placed = kept.save(forms.select("line", "leaf", "n", F.size("tokens").alias("size"), F.size(F.filter("tokens", lambda t: t.isNotNull())).alias("plain"), F.posexplode("tokens").alias("at", "token")), "placed")
    here = ["leaf", "at", "token"]
    constant = placed.where("token is not null").groupBy(*here).agg(F.sum("n").alias("all")).where(F.col("all") >= least).select(*here)
    shape: Column = F.xxhash64("at", "token")
    fixed = placed.join(constant.hint("merge"), here)
    shapes = fixed.groupBy("line").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.first("size").alias("size"), F.first("plain").alias("plain"), F.count("*").alias("fixed"), F.bit_xor(shape).alias("shape"), F.bit_xor(F.hash("token", "at")).alias("more"))
    shapes = kept.save(shapes.where((F.col("fixed") >= F.col("plain") * share) & (F.col("fixed") * 2 >= F.col("size"))), "shapes")
    own = ["leaf", "shape", "more"]
    often = shapes.groupBy(*own).agg(F.sum("n").alias("all")).where(F.col("all") >= least).select(*own)
    hit = shapes.join(often.hint("merge"), own, "left_semi").select("line", *own)
    seen = kept.save(lines.select("doc_id", "line").join(hit.hint("merge"), "line"), "seen")
    first = seen.groupBy(*own).agg(F.min("doc_id").alias("first"))
    later = seen.join(first.hint("merge"), own).where("not (doc_id <=> first)").select("doc_id", "line")
    later = later.union(copied(docs, kept, exact))
    return kept.save(later.groupBy("doc_id").agg(F.collect_set("line").alias("lines")), "lost")


def drop_templates(docs: DataFrame, least: int = LEAST, share: float = SHARE, exact: int = EXACT, added: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The columns of docs, the text without its recurring lines, and the two added ones, which replace columns of their name."""
    from pyspark.sql import types as T

    kept = Scratch(docs.sparkSession, "templates")
    docs = sources(docs, *[c for c in docs.columns if c.lower() not in {a.lower() for a in added}])
    own, lines = fresh(docs.columns, "__id"), fresh(docs.columns, "__lines")
    lost = recurring(docs, kept, least, share, exact).select(F.col("doc_id").alias(own), F.col("lines").alias(lines))
    joined = docs.join(lost.hint("merge"), F.col("doc_id").eqNullSafe(F.col(own)), "left").drop(own)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(a, T.LongType()) for a in added]])
    names = joined.columns
    return map_columns(joined, _edit(names.index("text"), names.index(lines), schema.names), schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256."""
    out = drop_templates(sources(docs, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], least: int = LEAST, share: float = SHARE, exact: int = EXACT) -> list[tuple[int, int, str]]:
    """n_lines, n_removed, kept_sha256 of each (doc_id, text), in plain Python, for tests."""
    support, forms = {}, {}
    per_leaf: dict = {}
    for _, text in rows:
        for tokens in map(tokens_of, (text or "").split("\n")):
            if tokens:
                forms[tuple(tokens)] = (len(tokens), *tokens[:DEPTH])
                support.setdefault(tuple(tokens), set()).add(text)
                per_leaf.setdefault(forms[tuple(tokens)], set()).add(text)
    counts: dict = {}
    for form, leaf in forms.items():
        for at, token in enumerate(form):
            if token != FIELD:
                counts[leaf, at, token] = counts.get((leaf, at, token), 0) + len(support[form])
    template, often = {}, {}
    for form, leaf in forms.items():
        fixed = tuple(t if t != FIELD and counts[leaf, k, t] >= least else None for k, t in enumerate(form))
        constants = sum(t is not None for t in fixed)
        if len(per_leaf[leaf]) >= least and constants >= share * sum(t != FIELD for t in form) and 2 * constants >= len(form):
            template[form] = (leaf, fixed)
            often[leaf, fixed] = often.get((leaf, fixed), 0) + len(support[form])
    first: dict = {}
    for doc_id, text in rows:
        for tokens in map(tokens_of, (text or "").split("\n")):
            t = template.get(tuple(tokens))
            if t and often[t] >= least and doc_id is not None:
                first[t] = min(doc_id, first.get(t, doc_id))
    holders: dict = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(line.strip(SPACE)) >= exact:
                holders.setdefault(line, []).append((text, doc_id))
    origin = {line: min((d for _, d in held if d is not None), default=None) for line, held in holders.items() if len({t for t, _ in held}) > 1}
    out = []
    for doc_id, text in rows:
        every = text.split("\n") if text else []
        keep = [x for x in every if not (t := template.get(tuple(tokens_of(x)))) or often[t] < least or first.get(t) == doc_id]
        keep = [x for x in keep if x not in origin or origin[x] == doc_id]
        out.append((len(every), len(every) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out
