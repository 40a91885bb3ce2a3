"""Which documents may share a passage: the first step of both substring operators.

A text is a row of units (words or bytes). Each window of ``span`` units has an anchor: the least hash of the
``gram``-unit windows inside it. Equal windows have equal anchors, so a window can repeat in another document only if
its anchor occurs there too. Anchors are few (about 2 / (span - gram) of the units), and only they are exchanged:
each task sorts its own, settles those it has from two documents itself, and sends one entry for each different
anchor, packed by bucket, so that an anchor of a third of all documents costs no more than one entry from each task.
What a bucket finds goes back packed by part, a set of documents that one task gathers, so there are never more rows
than entries, and far fewer while buckets and parts are few.

Texts whose units are all alike are one text from here on, that of the least doc_id. A null doc_id counts as greater
than all others. A document is known by its doc_id and 64 bits of its digest, so rows may share a doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, bit_filter, in_filter, slices, sources

LAST = (1 << 63) - 1
#: Anchor entries that a task holds before it sends them; bytes of text for each bucket.
HELD, BUCKET = 500_000, 16 << 20
#: Bytes of text, and documents, whose results one task gathers.
PART, PART_DOCS = 64 << 20, 400_000
#: Windows that are hashed at a time.
BLOCK = 1 << 15
#: An anchor that more documents have is hot; one that still more have is crowded.
HOT, CROWD = 4096, 1 << 18
CROWD_BITS = 1 << 20
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    out = x >> np.uint64(32)
    out ^= x
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _LEFT
    out += b * _RIGHT
    return mix(out)


def windows(units: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of so many units, a block of them at a time, so that all levels stay in the cache."""
    out = np.empty(max(0, len(units) - length + 1), np.uint64)
    for k in range(0, len(out), BLOCK):
        out[k : k + BLOCK] = doubled(units[k : k + BLOCK + length - 1], length)
    return out


def doubled(units: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window by doubling: two windows of one length side by side make one of twice it."""
    out, done, size, level = None, 0, 1, units
    while True:
        if length & size:
            # the parts' order is fixed by the length, so equal windows get equal hashes
            out = level[: len(units)] if out is None else paired(out[: max(0, len(level) - done)], level[done:])
            done += size
        if done == length:
            return out[: max(0, len(units) - length + 1)]
        level = paired(level[: max(0, len(level) - size)], level[size:])
        size *= 2


def least(values: np.ndarray, n: int) -> np.ndarray:
    """Least of each n values in a row."""
    size, level = 1, values
    while 2 * size <= n:
        level = np.minimum(level[: max(0, len(level) - size)], level[size:])
        size *= 2
    return np.minimum(level[: max(0, len(values) - n + 1)], level[n - size :][: max(0, len(values) - n + 1)])


@dataclass
class Kind:
    """units: hash of each unit of some texts put together, units of each text, and its units' bytes for the digest."""

    units: Callable[[list[str | None]], tuple[np.ndarray, np.ndarray, list[bytes]]]
    span: int
    gram: int

    def anchors(self, units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, text and anchor (48 bits) of each window that lies within one text."""
        if len(units) < self.span:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        found = least(windows(units, self.gram), self.span - self.gram + 1) >> np.uint64(16)
        ends = np.cumsum(sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)[: len(found)]
        place = np.flatnonzero(np.arange(len(found)) + self.span <= ends[text])
        return place, text[place], found[place]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, each byte of the values apart, compressed."""
    planes = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays))
    return zstandard.ZstdCompressor(1).compress(planes)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(planes) // sum(sizes), 0, []
    for k, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(planes[at : at + n * size].reshape(size, n).T).reshape(-1).view(k))
        at += n * size
    return out


def by_size(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Smaller batches of not more than so many bytes in a column, or of one row."""
    for batch in slices(batches):
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for k, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def batch_of(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.values())], list(schema))


def tag_of(digest: str) -> int:
    return int(digest[:16], 16) - (1 << 63)


def key_of(doc: int, tag: int) -> str:
    return xxhash.xxh3_64_hexdigest(f"{doc}:{tag}".encode())


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    return (mix(x.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def by_part(row: np.ndarray, value: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Rows and their anchors, packed by the part that gathers them."""
    if not len(row):
        return []
    part = part_of(row, parts)
    order = np.lexsort((value, row, part))
    part, row, value = part[order], row[order], value[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    return [(int(part[p[0]]), pack(np.diff(row[p], prepend=np.int64(0)), value[p])) for p in np.split(np.arange(len(row)), cuts)]


_SCAN = {"kind": pa.int32(), "row": pa.int64(), "part": pa.int64(), "doc": pa.int64(), "tag": pa.int64(), "n": pa.int64(), "sha": pa.string(), "bucket": pa.int64(), "packed": pa.binary()}
SCAN = "kind int, row long, part long, doc long, tag long, n long, sha string, bucket long, packed binary"


def _scan(kind: Kind, buckets: int, parts: int):
    """Rows of kind 0: a document. 1: anchors that are known to repeat, for a part. 2: entries for a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, row = TaskContext.get().partitionId() << 33, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            value, at = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            # one entry for each anchor and row
            order = np.argsort(value, kind="stable")  # rows came in order
            value, at = value[order], at[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1])
            value, at = value[new], at[new]
            first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(value)))
            several = np.repeat(count, count) > 1
            rows = [(1, None, part, None, None, None, None, None, data) for part, data in by_part(at[several], value[several], parts)]
            value, at, count = value[first], np.where(count > 1, -1, at[first] - base), np.minimum(count, CROWD + 1)
            bucket = (value % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")  # within a bucket the anchors stay sorted
            for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
                v = value[part]
                rows.append((2, base, None, None, None, None, None, int(bucket[part[0]]), pack(np.diff(v, prepend=np.uint64(0)), at[part].astype(np.int32), count[part].astype(np.int32))))
            for k in range(0, len(rows), 4096):
                yield batch_of(rows[k : k + 4096], _SCAN)

        for batch in by_size(batches, 1):
            units, sizes, plain = kind.units(batch.column(1).to_pylist())
            rows, home = [], part_of(np.arange(base + row, base + row + batch.num_rows), parts).tolist()
            for k, (doc, size, data) in enumerate(zip(batch.column(0).to_pylist(), sizes.tolist(), plain)):
                sha = hashlib.sha256(data).hexdigest()
                rows.append((0, base + row + k, home[k], LAST if doc is None else doc, tag_of(sha), size, sha, None, None))
            yield batch_of(rows, _SCAN)
            _, text, value = kind.anchors(units, sizes)
            turn = np.ones(len(value), bool)
            turn[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
            held.append((value[turn], text[turn] + row + base))
            row += len(rows)
            if sum(len(v) for v, _ in held) > HELD:
                yield from out()
        if held:
            yield from out()

    return run


_FOUND = {"part": pa.int64(), "packed": pa.binary()}


def _meet(parts: int):
    """Of a bucket's entries, those whose anchor another entry or document has, packed by part. Part -1: hot anchors, -2: crowded ones."""

    def run(table: pa.Table) -> pa.Table:
        values, rows, counts = [], [], []
        for base, data in zip(table.column("row").to_pylist(), table.column("packed").to_pylist()):
            v, at, n = unpack(data, "u8", "i4", "i4")
            values.append(np.cumsum(v, dtype=np.uint64))
            rows.append(np.where(at < 0, -1, at.astype(np.int64) + base))
            counts.append(n)
        value, at, count = np.concatenate(values), np.concatenate(rows), np.concatenate(counts).astype(np.int64)
        order = np.argsort(value, kind="stable")
        value, at, count = value[order], at[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        size = np.diff(np.append(first, len(value)))
        sums = np.add.reduceat(count, first)
        on = (np.repeat(sums, size) > 1) & (at >= 0)
        many = [(-1, value[first][sums > HOT]), (-2, value[first][sums > CROWD])]
        out = [(part, pack(hot)) for part, hot in many if len(hot)]
        return pa.Table.from_batches([batch_of([*out, *by_part(at[on], value[on], parts)], _FOUND)])

    return run


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array([f"{v:012x}" for v in unpack(data, "u8")[0].tolist()], pa.string())], ["key"])


_SHARED = {"doc": pa.int64(), "tag": pa.int64(), "packed": pa.binary()}


def _gather(own: pa.Table, found: pa.Table) -> pa.Table:
    """The anchors of a part's documents, one row for each document that has any."""
    packed = [unpack(x, "i8", "u8") for x in found.column("packed").to_pylist()]
    if not packed or not own.num_rows:
        return batch_table([], _SHARED)
    row, value = np.concatenate([np.cumsum(p[0]) for p in packed]), np.concatenate([p[1] for p in packed])
    mine, doc, tag = [own.column(c).to_numpy() for c in ("row", "doc", "tag")]
    order = np.argsort(mine, kind="stable")
    mine, doc, tag = mine[order], doc[order], tag[order]
    at = np.minimum(np.searchsorted(mine, row), len(mine) - 1)
    on = mine[at] == row
    at, value = at[on], value[on]
    order = np.lexsort((value, at))
    at, value = at[order], value[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    return batch_table([(int(doc[at[p[0]]]), int(tag[at[p[0]]]), pack(value[p])) for p in np.split(np.arange(len(at)), cuts)] if len(at) else [], _SHARED)


def batch_table(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.Table:
    return pa.Table.from_batches([batch_of(rows, schema)])


def candidates(docs: DataFrame, kind: Kind, kept: Scratch) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """All documents (doc, tag, n, sha, least: the least doc of the same units), those that may share a window with
    another text (doc, tag, packed: the anchors that repeat), and a filter that has all hot anchors."""
    plain = sources(docs, "doc_id", "text")
    size, rows = plain.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size = size or 0
    parts = size // PART + rows // PART_DOCS + 1
    scan = kept.save(plain.mapInArrow(_scan(kind, size // BUCKET + 1, parts), SCAN), "scan")
    every = scan.where("kind = 0").select("row", "part", "doc", "tag", "n", "sha").withColumn("task", F.shiftright("row", 33))
    # Copies meet by task first, so that a text of very many documents is a row of each task.
    local = every.groupBy("task", "sha").agg(F.min("doc").alias("low"))
    least = local.join(local.groupBy("sha").agg(F.min("low").alias("least")).hint("merge"), "sha").select("task", "sha", "least")
    every = kept.save(every.join(least.hint("merge"), ["task", "sha"]).drop("task"), "every")
    met = scan.where("kind = 2").select("bucket", "row", "packed").groupBy("bucket").applyInArrow(_meet(parts), "part long, packed binary")
    met = kept.save(met, "met")
    hot = bit_filter(met.where("part = -1").select("packed").mapInArrow(_values, "key string"))
    found = scan.where("kind = 1").select("part", "packed").unionByName(met.where("part >= 0"))
    own = every.where(F.col("doc") == F.col("least")).where(F.col("n") >= kind.span).select("part", "row", "doc", "tag")
    shared = own.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_gather, "doc long, tag long, packed binary")
    # Rows may share doc_id and text.
    shared = kept.save(shared.groupBy("doc", "tag").agg(F.collect_list("packed").alias("packed")), "shared")
    kept.drop("scan")
    return every.drop("row", "part"), shared, hot


def crowd(kept: Scratch) -> np.ndarray:
    """A filter that has all crowded anchors, after candidates()."""
    met = kept.spark.read.schema("part long, packed binary").parquet(kept.path("met"))
    return bit_filter(met.where("part = -2").select("packed").mapInArrow(_values, "key string"), CROWD_BITS)


def among(value: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which anchors a filter lets pass."""
    spot = (value % np.uint64(32 * len(bits))).astype(np.int64)
    return (bits[spot >> 5] >> (spot & 31).astype(np.uint32) & np.uint32(1)) > 0


def with_text(docs: DataFrame, kind: Kind, table: DataFrame) -> DataFrame:
    """The table's rows (by doc, tag) with the documents' texts, compressed. Only texts that may be asked for move."""
    key = F.lower(F.lpad(F.hex(F.xxhash64("doc", "tag")), 16, "0"))
    bits = bit_filter(table.select(key.alias("key")))

    def tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in by_size(batches, 1):
            texts = batch.column(1).to_pylist()
            docs, tagged, packed = [], [], []
            for doc, text, data in zip(batch.column(0).to_pylist(), texts, kind.units(texts)[2]):
                docs.append(LAST if doc is None else doc)
                tagged.append(tag_of(hashlib.sha256(data).hexdigest()))
                packed.append(press.compress((text or "").encode()))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tagged, pa.int64()), pa.array(packed, pa.binary())], ["doc", "tag", "text"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([in_filter(bits, k) for k in batch.column(3).to_pylist()], pa.bool_()))

    texts = sources(docs, "doc_id", "text").mapInArrow(tags, "doc long, tag long, text binary").withColumn("key", key)
    texts = texts.mapInArrow(pick, "doc long, tag long, text binary, key string").drop("key")
    texts = texts.groupBy("doc", "tag").agg(F.first("text").alias("text"))
    return table.join(texts.hint("merge"), ["doc", "tag"])


def texts_of(column: pa.Array) -> list[str]:
    unpress = zstandard.ZstdDecompressor()
    return [unpress.decompress(x).decode() for x in column.to_pylist()]


def known(packed: list[list[bytes]]) -> list[np.ndarray]:
    """For each text its anchors that repeat, sorted."""
    return [np.sort(np.concatenate([unpack(p, "u8")[0] for p in parts])) for parts in packed]


def marked(text: np.ndarray, value: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """Which windows have an anchor that repeats."""
    on = np.zeros(len(text), bool)
    starts = np.searchsorted(text, np.arange(len(values) + 1))
    for k, v in enumerate(values):
        a, b = starts[k], starts[k + 1]
        if a < b and len(v):
            on[a:b] = v[np.minimum(np.searchsorted(v, value[a:b]), len(v) - 1)] == value[a:b]
    return on


def covered(places: np.ndarray, span: int, n: int) -> np.ndarray:
    """Which of n units lie in a window that starts at one of the places."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, places, 1)
    np.add.at(steps, np.minimum(places + span, n), -1)
    return np.cumsum(steps)[:n] > 0


_SPOTS = {"doc": pa.int64(), "tag": pa.int64(), "places": pa.binary()}
SPOTS = "doc long, tag long, places binary"


def spots(doc: np.ndarray, tag: np.ndarray, place: np.ndarray) -> list[tuple]:
    """Places packed by document."""
    order = np.lexsort((place, tag, doc))
    doc, tag, place = doc[order], tag[order], place[order]
    cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(tag) != 0)) + 1
    return [(int(doc[p[0]]), int(tag[p[0]]), place[p].astype("<i4").tobytes()) for p in np.split(np.arange(len(doc)), cuts)] if len(doc) else []


def dealt(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Places packed by the part that gathers their documents."""
    part = part_of(doc ^ tag, parts)
    order = np.lexsort((place, tag, doc, part))
    part, doc, tag, place = part[order], doc[order], tag[order], place[order].astype(np.int32)
    cuts = np.flatnonzero(np.diff(part)) + 1
    return [(int(part[p[0]]), pack(doc[p], tag[p], place[p])) for p in np.split(np.arange(len(doc)), cuts)] if len(doc) else []


def by_document(table: pa.Table) -> pa.Table:
    """All places of a part's documents, one row for each document."""
    parts = [unpack(x, "i8", "i8", "i4") for x in table.column("packed").to_pylist()]
    return pa.Table.from_batches([batch_of(spots(*[np.concatenate(x) for x in zip(*parts)]), _SPOTS)])
