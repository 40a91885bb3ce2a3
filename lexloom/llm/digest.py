"""Document fingerprints: a canonical exact digest.

A text is normalised (NFKC), case-folded and its white space folded; the fingerprint is the 128-bit xxh3 digest of
the UTF-8 bytes. Texts whose digests are equal are compared byte by byte; if they differ, a second digest is
appended to the fingerprint of each. Likeness is therefore 1.0 or 0.0.

Nulls and empty texts have the digest of the empty string. Rows that share a doc_id are ordered by their text. A
null doc_id comes first. The only document of a table is its own next document. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, bit_filter, in_filter, slices, sources


def canonical(text: str | None) -> bytes:
    text = unicodedata.normalize("NFKC", text or "")
    text = unicodedata.normalize("NFKC", text.casefold())
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(3)
    for batch in slices(batches):
        packed = [press.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGE = "part int, first_packed binary, first_digest string, packed binary"


def _row(doc_id, text: str, own: str, following: str, next_digest: str) -> tuple:
    changed = edited(text, following)
    other = digest(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, float(own == other), float(own == next_digest)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One run of documents in order: a row for each but the last, which waits in the run's edge row."""
    names = [x.split()[0] for x in f"{_RESULT}, {_EDGE}".split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.string(), pa.binary()]
    unpack = zstandard.ZstdDecompressor()
    first = last = None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in slices(batches):
        rows = []
        for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = unpack.decompress(packed).decode()
            now = (doc_id, text, digest(text), packed)
            if last is None:
                first = now
            else:
                rows.append((*_row(*last[:3], now[1], now[2]), None, None, None, None))
            last = now
        if rows:
            yield out(rows)
    if last is not None:
        yield out([(last[0], None, None, last[2], None, None, None, TaskContext.get().partitionId(), first[3], first[2], last[3])])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last document of each run with the first of the next run."""
    unpack = zstandard.ZstdDecompressor()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in slices(batches):
        rows = []
        for r in batch.to_pylist():
            rows.append(_row(r["doc_id"], unpack.decompress(r["packed"]).decode(), r["fingerprint"], unpack.decompress(r["next_packed"]).decode(), r["next_digest"]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _RESULT.split(", ")])


def collisions(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """key: the digests that texts of different canonical bytes share; repeated has the digests of two texts or more."""
    bits = bit_filter(repeated)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in slices(batches):
            keys, packed = [], []
            for text in batch.column(0).to_pylist():
                plain = canonical(text)
                key = xxhash.xxh3_128_hexdigest(plain)
                if in_filter(bits, key):
                    keys.append(key)
                    packed.append(press.compress(plain))  # equal if and only if the bytes are
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(packed, pa.binary())], ["key", "packed"])

    # Grouping compares the keys' bytes; each task passes on one row for each different text.
    same = sources(docs, "text").mapInArrow(pick, "key string, packed binary").groupBy("key", "packed").agg(F.lit(1).alias("one"))
    return same.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each document, in the columns of _RESULT."""
    spark = docs.sparkSession
    kept = Scratch(spark, "fingerprints")
    packed = sources(docs, "doc_id", "text").mapInArrow(_pack, "doc_id long, packed binary")
    runs = packed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "packed")
    rows = kept.save(runs.mapInArrow(_chain, f"{_RESULT}, {_EDGE}"), "rows")
    edges = rows.where("part is not null")
    # As many edges as partitions; their order needs the partition numbers alone.
    order = edges.select("part")
    order = order.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_part"))
    after = edges.select(F.col("part").alias("next_part"), F.col("first_packed").alias("next_packed"), F.col("first_digest").alias("next_digest"))
    ends = edges.select("part", "doc_id", "packed", "fingerprint").join(order, "part").join(after, "next_part")
    ends = ends.select("doc_id", "packed", "fingerprint", "next_packed", "next_digest").mapInArrow(_close, _RESULT)
    every = rows.where("part is null").select(*[x.split()[0] for x in _RESULT.split(", ")]).unionByName(ends)
    every = kept.save(every, "every")
    repeated = every.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select(F.col("fingerprint").alias("key"))
    clash = kept.save(collisions(docs, repeated), "collisions")
    if clash.isEmpty():
        return every
    return resolve(docs, every, clash)


def resolve(docs: DataFrame, every: DataFrame, clash: DataFrame) -> DataFrame:
    """Tells apart texts of the digests in clash by a SHA-256 digest of their canonical bytes."""
    bits = bit_filter(clash)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain = canonical(text)
                key = xxhash.xxh3_128_hexdigest(plain)
                if in_filter(bits, key):
                    rows.append((doc_id, len(text or ""), key, hashlib.sha256(plain).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["id", "chars", "key", "more"])

    apart = sources(docs, "doc_id", "text").mapInArrow(pick, "id long, chars long, key string, more string").join(clash, "key").distinct()
    on = every["doc_id"].eqNullSafe(apart["id"]) & (every["n_chars"] == apart["chars"]) & (every["fingerprint"] == apart["key"])
    named = F.when(F.col("more").isNull(), F.col("fingerprint")).otherwise(F.concat_ws("-", "fingerprint", "more"))
    return every.join(apart, on, "left").withColumn("fingerprint", named).select(*every.columns)
