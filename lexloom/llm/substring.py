"""Substring dedup by level-wise doubling over words.

The lengths double: windows of 25 words that occur in one document alone are dropped, and only windows of 50 words
made of survivors go on (of the 25-word windows inside a 50-word window, the least hash is the one that must have
survived: see anchors.py). A word goes if a 50-word window over it also starts in a document with a smaller doc_id. No
longer windows are needed: any longer repeat is a row of repeats of 50.

A 50-word window is known by 96 bits of hash. Each task settles windows that it has from two documents itself and
sends one document's places for each different window, so common passages stay cheap.

Null and empty texts have no words; a null doc_id counts as greater than all others; rows that share a doc_id never
remove words from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import anchors
from lexloom.llm.anchors import Kind
from lexloom.llm.common import Scratch, slices

SPAN = 50
CACHE = 300_000


class Words:
    """Hashes of words; what a worker has seen it keeps, up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        if len(self.known) > CACHE:
            self.known.clear()
        known, hashed, sizes, plain = self.known, [], [], []
        for text in texts:
            words = text.encode().split() if text else []
            got = [known.get(w) for w in words]
            if None in got:
                for k, h in enumerate(got):
                    if h is None:
                        got[k] = known[words[k]] = xxhash.xxh3_64_intdigest(words[k])
            hashed.append(np.array(got, np.uint64))
            sizes.append(len(words))
            plain.append(b" ".join(words))
        return np.concatenate(hashed) if hashed else np.zeros(0, np.uint64), np.array(sizes, np.int64), plain


_PLACES = {"kind": pa.int32(), "doc": pa.int64(), "tag": pa.int64(), "places": pa.binary(), "bucket": pa.int64(), "packed": pa.binary()}
PLACES = "kind int, doc long, tag long, places binary, bucket long, packed binary"


def _windows(kind: Kind, buckets: int):
    """Rows of kind 1: places to remove, settled here. 2: windows for a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            one, two, doc, tag, place = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            order = np.lexsort((doc, two, one))
            one, two, doc, tag, place = [x[order] for x in (one, two, doc, tag, place)]
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            low = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            gone = doc > low
            rows = [(1, *s, None, None) for s in anchors.spots(doc[gone], tag[gone], place[gone])]
            one, two, doc, tag, place = [x[~gone] for x in (one, two, doc, tag, place)]
            bucket = (one % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
                rows.append((2, None, None, None, int(bucket[part[0]]), anchors.pack(np.diff(one[part], prepend=np.uint64(0)), two[part], doc[part], tag[part], place[part].astype(np.int32))))
            for k in range(0, len(rows), 2048):
                yield anchors.batch_of(rows[k : k + 2048], _PLACES)

        for batch in anchors.by_size(batches, 2, 1 << 17):
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            units, sizes, _ = kind.units(anchors.texts_of(batch.column(2)))
            place, text, value = kind.anchors(units, sizes)
            on = anchors.marked(text, value, anchors.known(batch.column(3).to_pylist()))
            half = anchors.windows(units, kind.gram)
            place, text = place[on], text[on]
            left, right = half[place], half[place + kind.span - kind.gram]
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            held.append((anchors.paired(left, right), (anchors.mix(left + anchors.paired(right, left)) >> np.uint64(32)).astype(np.uint32), doc[text], tag[text], place - start[text]))
            if sum(len(h[0]) for h in held) > anchors.HELD:
                yield from out()
        if held:
            yield from out()

    return run


def _later(table: pa.Table) -> pa.Table:
    """Of a bucket's windows, the places where a smaller document has the window."""
    parts = [anchors.unpack(x, "u8", "u4", "i8", "i8", "i4") for x in table.column("packed").to_pylist()]
    one = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    two, doc, tag, place = [np.concatenate(x) for x in list(zip(*parts))[1:]]
    order = np.lexsort((doc, two, one))
    one, two, doc, tag, place = [x[order] for x in (one, two, doc, tag, place)]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    gone = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    return pa.Table.from_batches([anchors.batch_of(anchors.spots(doc[gone], tag[gone], place[gone]), anchors._SPOTS)])


def _cut(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = {"doc": pa.int64(), "tag": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
        for batch in slices(batches):
            rows = []
            for doc, tag, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), anchors.texts_of(batch.column(2)), batch.column(3).to_pylist()):
                words = text.encode().split()
                out = anchors.covered(np.frombuffer(b"".join(places), "<i4"), kind.span, len(words))
                kept = b" ".join([w for w, gone in zip(words, out.tolist()) if not gone])
                rows.append((doc, tag, int(out.sum()), hashlib.sha256(kept).hexdigest()))
            yield anchors.batch_of(rows, schema)

    return run


def dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    spark = docs.sparkSession
    kept = Scratch(spark, "substring")
    kind = Kind(Words(), span, span // 2)
    every, shared, _ = anchors.candidates(docs, kind, kept)
    size = every.agg(F.sum("n")).first()[0] or 0
    held = anchors.with_text(docs, kind, shared).select("doc", "tag", "text", "packed")
    found = kept.save(held.mapInArrow(_windows(kind, size // (8 << 20) + 1), PLACES), "windows")
    met = found.where("kind = 2").select("bucket", "packed").groupBy("bucket").applyInArrow(_later, anchors.SPOTS)
    places = found.where("kind = 1").select("doc", "tag", "places").unionByName(met).groupBy("doc", "tag").agg(F.collect_list("places").alias("places"))
    places = kept.save(places, "places")
    kept.drop("windows")
    edited = anchors.with_text(docs, kind, places).select("doc", "tag", "text", "places").mapInArrow(_cut(kind), "doc long, tag long, n_removed long, kept_sha256 string")
    out = every.join(edited.hint("merge"), ["doc", "tag"], "left")
    return finished(out, span, [])


def finished(out: DataFrame, span: int, more: list) -> DataFrame:
    """Results of copies of a text follow from its size; those of texts that lose nothing are known from the start."""
    doc_id = F.when(F.col("doc") != anchors.LAST, F.col("doc")).alias("doc_id")
    copy = (F.col("doc") > F.col("least")) & (F.col("n") >= span)
    removed = F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    sha = F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha"))
    return out.select(doc_id, F.col("n").alias("n_words"), removed.alias("n_removed"), *[f(copy) for f in more], sha.alias("kept_sha256"))
