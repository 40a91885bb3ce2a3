"""Token ids in a content-addressed store.

Texts are encoded with a public tokenizer; each document's ids, with an end id, are cut into chunks where a rolling
hash of the last ids says so, so that equal passages give equal chunks. A chunk's name is a digest of its ids and each
chunk is stored once. A document is a recipe: the list of its chunk names and their Merkle root. Recipes lie in
ascending doc_id order in shards, each with a Merkle root over its documents' roots; the manifest lists the shards.

Files, all Parquet: ``blobs/kind=1`` chunks (name, width, ids), ``blobs/kind=0`` unordered recipes, ``recipes``
(shard, doc_id, start_in_shard, n_tokens, root, chunks) in order, ``manifest`` (shard, n_docs, n_tokens, root).
Reading checks every chunk against its name, every recipe against its root and every shard against the manifest.

Nulls and empty texts have the end id alone. Rows that share a doc_id are ordered by their roots; a null doc_id
comes first. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.anchors import by_size
from lexloom.llm.common import slices, sources

END_ID = 1
#: Ids in the rolling hash; bits that must be zero for a cut (512 ids on average); least and most ids of a chunk.
ROLL, CUT_BITS, LEAST, MOST = 16, 9, 128, 4096
#: Encoded words that a worker keeps (twice as many for a while).
CACHE = 500_000
_split = re.compile(r"[\x20\x09-\x0D]+").split
#: First code point beyond Latin; for each before it: 0 letters, digits and plain white space, 1 marks, 2 what is odd.
_BEYOND = 0x250
_KIND = np.array([2 if c in "\x1c\x1d\x1e\x1f\x85\xa0\u0130" else int(not c.isspace() and not c.isalnum()) for c in map(chr, range(_BEYOND))], np.uint8)
_BASE = 0x9E3779B97F4A7C15


def odd(text: str) -> bool:
    """What keeps a text from the quick way: other white space, letters beyond Latin, marks side by side."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if int(points.max()) >= _BEYOND:
        return True
    kind = _KIND[points]
    mark = kind == 1
    return bool((kind == 2).any() or (mark[1:] & mark[:-1]).any())


def split(text: str) -> list[str]:
    """Parts whose ids, one after the other, are the text's: words between ASCII white space.

    In a plain text the stops stand by themselves and letters are lower case, as the tokenizer makes them, so that
    fewer different parts are left to encode.
    """
    if odd(text):
        return _split(text)
    text = text.lower()
    for stop in ".,;:!?|":
        if stop in text:
            text = text.replace(stop, f" {stop} ")
    return text.split()


class Encoder:
    """Ids of whole texts as little-endian bytes, for lower-casing tokenizers that split at white space and marks.

    A part that occurred before needs no second encoding. Parts of letters alone are encoded many at a time, and told
    apart by the mark that ends each word's last piece.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        from tokenizers.normalizers import Sequence

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = Sequence([])  # for what is lower-case ASCII already
        self.mark, self.mark_id = next(((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items()), (None, -1))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        ends = [i for piece, i in vocabulary.items() if piece.endswith("</w>")]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[ends] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known  # words that come again come back from the older ones
        self.known[""] = b""
        known, older = self.known, self.older
        parts = [split(t) if t else [] for t in texts]
        new = set().union(*parts).difference(known)
        if older and new:
            again = {w: older[w] for w in new if w in older}
            known.update(again)
            new.difference_update(again)
        if new:
            plain = [w for w in new if w.isascii() and w.isalpha() and w.islower()]
            self._together(plain, self.plain)
            new.difference_update(plain)
            letters = [w for w in new if w.isalpha()]
            self._together(letters, self.tokenizer)
            self._apart(list(new.difference(letters)))
        return [b"".join(map(known.__getitem__, ws)) for ws in parts]

    def _together(self, words: list[str], tokenizer) -> None:
        groups = [words[k : k + 200] for k in range(0, len(words), 200)]
        for group, e in zip(groups, tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(group) or (len(ends) and ends[-1] != len(ids)):
                self._apart(group)
            else:
                self._keep(group, ids.tobytes(), ends.tolist(), 0)

    def _apart(self, words: list[str]) -> None:
        """Words of any kind, with an added token between them where the file has one."""
        alone = [w for w in words if self.mark is None or "<" in w]
        joined = [w for w in words if not (self.mark is None or "<" in w)]
        groups = [joined[k : k + 200] for k in range(0, len(joined), 200)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([self.mark.join([*g, ""]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) != len(group):
                alone.extend(group)
            else:
                self._keep(group, ids.tobytes(), ends.tolist(), 1)
        for k in range(0, len(alone), 4096):
            part = alone[k : k + 4096]
            for word, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[word] = np.array(e.ids, "<u4").tobytes()

    def _keep(self, words: list[str], data: bytes, ends: list[int], gap: int) -> None:
        at = 0
        for word, end in zip(words, ends):
            self.known[word] = data[4 * at : 4 * end]
            at = end + gap


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder that this worker has for the file: what one task has met, the next need not encode again."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a stream may be cut: where the hash of the last ids has its top bits zero."""
    if len(ids) < ROLL:
        return np.zeros(0, np.int64)
    rolled = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    rolled ^= rolled >> np.uint64(32)
    size, factor = 1, _BASE
    while size < ROLL:  # two hashes side by side make that of twice the length
        rolled = rolled[:-size] * np.uint64(factor) + rolled[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    return np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + ROLL


def cuts_at(places: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids that may be cut at the places, within the bounds on the length."""
    if n <= LEAST:
        return [n] if n else []
    out, at = [], 0
    for m in places:
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= LEAST and m < n:
            out.append(m)
            at = m
    while n - at > MOST:
        at += MOST
        out.append(at)
    return [*out, n]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream."""
    return cuts_at(marks(ids).tolist(), len(ids))


def cuts_of(ids: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Ends of the chunks of streams put together, each as if it were alone."""
    ends = np.cumsum(sizes)
    places = marks(ids)
    stream = np.searchsorted(ends, places - 1, side="right")
    start = ends - sizes
    on = places - start[stream] >= ROLL
    places, stream = (places - start[stream])[on], stream[on]
    first = np.searchsorted(stream, np.arange(len(sizes) + 1))
    places = places.tolist()
    return [cuts_at(places[a:b], n) for a, b, n in zip(first[:-1].tolist(), first[1:].tolist(), sizes)]


def name_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(names: list[bytes]) -> bytes:
    """Root of the binary tree over the names; an odd last one goes up as it is."""
    level = names or [name_of(b"")]
    while len(level) > 1:
        up = [name_of(a + b) for a, b in zip(level[::2], level[1::2])]
        level = up + level[-1:] if len(level) % 2 else up
    return level[0]


class Tree:
    """The same root over a sequence of any length, in memory that grows with its logarithm."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, bytes]] = []

    def add(self, name: bytes) -> None:
        height = 0
        while self.parts and self.parts[-1][0] == height:
            name, height = name_of(self.parts.pop()[1] + name), height + 1
        self.parts.append((height, name))

    def root(self) -> bytes:
        if not self.parts:
            return name_of(b"")
        out = self.parts[-1][1]
        for _, name in reversed(self.parts[:-1]):
            out = name_of(name + out)
        return out


_BLOB = "kind int, name binary, doc_id long, n_tokens long, ids binary, chunks array<binary>"


def _blobs(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, prefix, row = encoder_of(path), TaskContext.get().partitionId().to_bytes(4, "big"), 0
        end = int(end_id).to_bytes(4, "little")
        seen: set[bytes] = set()
        for batch in by_size(batches, 1, 1 << 19):
            out = []
            coded = [c + end for c in encoder.encode(batch.column(1).to_pylist())]
            whole, base = b"".join(coded), 0
            sizes = [len(c) // 4 for c in coded]
            ids = np.frombuffer(whole, "<u4")
            short, narrow = ids.astype("<u2").tobytes(), bool(ids.max(initial=0) < 65536)
            for doc_id, n, ends in zip(batch.column(0).to_pylist(), sizes, cuts_of(ids, sizes)):
                at, names = base, []
                for to in ends:
                    to += base
                    name = name_of(whole[4 * at : 4 * to])
                    if name not in seen:
                        packed = short[2 * at : 2 * to] if narrow or ids[at:to].max() < 65536 else whole[4 * at : 4 * to]
                        out.append((1, name, None, to - at, packed, None))
                        seen.add(name)
                    names.append(name)
                    at = to
                out.append((0, prefix + row.to_bytes(8, "big"), doc_id, n, None, names))
                row, base = row + 1, base + n
            if len(seen) > 100_000:
                seen.clear()  # what it no longer knows is told apart later, by the grouping
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in _BLOB.split(", ")])

    return run


_RECIPE = "shard int, doc_id long, start_in_shard long, n_tokens long, root binary, chunks array<binary>, sum_docs long, sum_root binary"


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes of a shard in order; its last row (doc_id and chunks null) has the shard's sums."""
    here, start, docs, tree = TaskContext.get().partitionId(), 0, 0, Tree()
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.binary())
    names = [x.split()[0] for x in _RECIPE.split(", ")]
    for batch in slices(batches, 1024):
        out = []
        for doc_id, n, root, chunks in zip(*[c.to_pylist() for c in batch.columns]):
            out.append((here, doc_id, start, n, root, chunks, None, None))
            start, docs = start + n, docs + 1
            tree.add(root)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((here, None, None, start, None, None, docs, tree.root()), kinds)], names)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1024):
        roots = [merkle(c) for c in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roots, pa.binary()), batch.column(2)], ["doc_id", "n_tokens", "root", "chunks"])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the store of all documents to a folder of Spark's file system."""
    spark = docs.sparkSession
    blobs = sources(docs, "doc_id", "text").mapInArrow(_blobs(tokenizer, end_id), _BLOB)
    once = blobs.groupBy("kind", "name").agg(*[F.first(c).alias(c) for c in ("doc_id", "n_tokens", "ids", "chunks")])
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/blobs")
    schema = "name binary, doc_id long, n_tokens long, ids binary, chunks array<binary>, kind int"
    recipes = spark.read.schema(schema).parquet(f"{path}/blobs").where("kind = 0").select("doc_id", "n_tokens", "chunks")
    recipes = recipes.mapInArrow(_roots, "doc_id long, n_tokens long, root binary, chunks array<binary>")
    shards = recipes.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "root").mapInArrow(_shard, _RECIPE)
    shards.write.option("compression", "zstd").parquet(f"{path}/all")
    every = spark.read.schema(_RECIPE).parquet(f"{path}/all")
    every.where("sum_docs is null").drop("sum_docs", "sum_root").write.option("compression", "zstd").parquet(f"{path}/recipes")
    every.where("sum_docs is not null").select("shard", F.col("sum_docs").alias("n_docs"), "n_tokens", F.col("sum_root").alias("root")).coalesce(1).write.parquet(f"{path}/manifest")


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, recipes and manifest."""
    blobs = spark.read.schema("name binary, doc_id long, n_tokens long, ids binary, chunks array<binary>, kind int").parquet(f"{path}/blobs")
    recipes = spark.read.schema("shard int, doc_id long, start_in_shard long, n_tokens long, root binary, chunks array<binary>").parquet(f"{path}/recipes")
    manifest = spark.read.schema("shard int, n_docs long, n_tokens long, root binary").parquet(f"{path}/manifest")
    return blobs.where("kind = 1").select("name", "n_tokens", "ids"), recipes, manifest


def widened(data: bytes, n: int) -> bytes:
    """A chunk's ids as 32-bit integers."""
    return data if len(data) == 4 * n else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1024):
        crcs = []
        for name, n, data in zip(*[c.to_pylist() for c in batch.columns]):
            ids = widened(data, n)
            if name_of(ids) != name:
                raise ValueError(f"chunk {name.hex()} does not match its name")
            crcs.append(zlib.crc32(ids))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], ["name", "n", "crc"])


def _powers() -> np.ndarray:
    """For 2**k zero bytes, the 32 columns of what they do to a CRC-32."""
    one = np.array([0xEDB88320, *[1 << k for k in range(31)]], np.uint64)  # one zero bit

    def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.array([int(np.bitwise_xor.reduce(a[[k for k in range(32) if int(v) >> k & 1]], initial=np.uint64(0))) for v in b], np.uint64)

    for _ in range(3):
        one = times(one, one)
    out = [one]
    for _ in range(33):
        out.append(times(out[-1], out[-1]))
    return np.array(out)


_POWERS = _powers()


def append_zeros(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs of the same data followed by n zero bytes, up to the sign bits that the end of a CRC adds."""
    crc = crc.astype(np.uint64)
    for k in range(int(n.max(initial=0)).bit_length()):
        on = (n >> k & 1).astype(bool)
        if on.any():
            c, out = crc[on], np.zeros(int(on.sum()), np.uint64)
            for b in range(32):
                out ^= _POWERS[k, b] * (c >> np.uint64(b) & np.uint64(1))
            crc[on] = out
    return crc


def combined(size: np.ndarray, crc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of the parts of each list put together, from bytes and CRC of each part; first: where each list starts, and the end.

    Neighbours of a list become one, again and again, all lists at a time.
    """
    out, count = np.zeros(len(first) - 1, np.int64), np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(owner)) - first[owner]
    size, crc = size.astype(np.int64), crc.astype(np.uint64)
    while place.any():
        left = np.flatnonzero(place % 2 == 0)
        pair = np.flatnonzero(np.append(owner, -1)[left + 1] == owner[left])
        right = left[pair] + 1
        more, sizes = crc[left], size[left]
        more[pair] = append_zeros(more[pair], size[right]) ^ crc[right]
        sizes[pair] += size[right]
        owner, place, size, crc = owner[left], place[left] // 2, sizes, more
    out[owner] = crc
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2048):
        parts = batch.column(1)
        first = np.append(0, np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False)))
        flat = parts.flatten()
        n, crc, names = flat.field("n").to_numpy(), flat.field("crc").to_numpy(), flat.field("name").to_pylist()
        for root, a, b in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
            if merkle(names[a:b]) != root:
                raise ValueError(f"recipe {root.hex()} does not match its root")
        upto = np.append(0, np.cumsum(n))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(upto[first[1:]] - upto[first[:-1]]), pa.array(combined(4 * n, crc, first))], ["root", "n_read", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all checked against names, roots and manifest.

    The checksum of a document follows from those of its chunks, so each stored chunk is read once and no ids move.
    """
    broken = [r["shard"] for r in verify_manifest(spark, path).orderBy("shard").limit(20).collect()]
    if broken:
        raise ValueError(f"shards that do not match the manifest: {', '.join(map(str, broken))}")
    chunks, recipes, manifest = open_store(spark, path)
    sums = chunks.mapInArrow(_sums, "name binary, n long, crc long")
    different = recipes.select("root", "chunks").groupBy("root").agg(F.first("chunks").alias("chunks"))
    parts = different.select("root", F.posexplode("chunks").alias("at", "name")).join(sums, "name")
    whole = parts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("at", "n", "crc", "name"))).alias("parts"))
    whole = whole.select("root", "parts").mapInArrow(_joined, "root binary, n_read long, ids_crc32 long")
    # As many rows as shards.
    shards = manifest.select("shard", "n_tokens", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = recipes.select("shard", "doc_id", "start_in_shard", "n_tokens", "root").join(shards.select("shard", "before"), "shard").join(whole, "root", "left")
    bad = F.raise_error(F.concat(F.lit("recipe without all its chunks: "), F.hex("root")))
    read_all = F.when(F.col("n_read") == F.col("n_tokens"), F.col("n_tokens")).otherwise(bad)
    return rows.select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), read_all.cast("long").alias("n_tokens"), "ids_crc32")


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """shard: shards whose recipes do not give the manifest's root and counts, or are not in it; none if the store is whole."""
    _, recipes, manifest = open_store(spark, path)

    def roots(key, frame):
        import pandas as pd

        tree = Tree()
        for r in frame.sort_values("start_in_shard", kind="stable")["root"]:
            tree.add(bytes(r))
        return pd.DataFrame({"shard": [key[0]], "found": [tree.root()], "docs": [len(frame)], "tokens": [int(frame["n_tokens"].sum())]})

    found = recipes.select("shard", "start_in_shard", "root", "n_tokens").groupBy("shard").applyInPandas(roots, "shard int, found binary, docs long, tokens long")
    return manifest.join(found, "shard", "full").where("not (root <=> found and n_docs <=> docs and n_tokens <=> tokens)").select("shard")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit integers): the streams themselves."""
    chunks, recipes, _ = open_store(spark, path)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = [b"".join(widened(p["ids"], p["n_tokens"]) for p in parts) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "ids"])

    parts = recipes.select("doc_id", "shard", "start_in_shard", F.posexplode("chunks").alias("at", "name")).join(chunks, "name")
    whole = parts.groupBy("doc_id", "shard", "start_in_shard").agg(F.array_sort(F.collect_list(F.struct("at", "n_tokens", "ids"))).alias("parts"))
    return whole.select("doc_id", "parts").mapInArrow(put, "doc_id long, ids binary")
