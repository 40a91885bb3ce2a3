"""MinHash near-duplicates with HyperMinHash registers.

A document's set is the distinct n-word shingles of its text, lower-cased in A-Z; a text of fewer words has its whole
sequence as its one shingle, a text without words or no text has none and is linked with nothing. Documents are linked
if 100 |A and B| >= 100 s |A or B|; a class is a connected component of the links.

Sketch: for each of ``BANDS * ROWS`` hash functions the least value over the set is kept as its count of leading zeros
and ten mantissa bits, 16 bits in all. Equal sets are one node from here on, so copies cost nothing. Nodes that agree
in a band of ROWS registers are candidates. At similarity 0.8 a pair misses all bands with probability
(1 - 0.8**5)**32 = 3e-6.

Candidates are found without all pairs of a band's group. Each group has a pivot, its member with the most candidates;
every member is compared with it. A member that is linked to the pivot needs no more. For the others let D be what a
set and the pivot do not share: two sets of one pivot, one of them not linked to it, can only be linked if their D have
at least o = (|D1| + |D2| - r (|A| + |B|)) / 2 > 0 elements in common, with r = (100 - s) / (100 + s). So they must
share one of the first |D| - o + 1 elements of D, those first that fewer sets of the pivot have, with o or more elements
of either D from there on, and only pairs that do are compared. What copies of one text have in common takes no part. Before the exact test the registers' agreement, corrected for chance
collisions, drops pairs six standard deviations under the threshold.

Null doc_ids make rows like others, but name no class unless all of a class are null. Repeated rows are each returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, bit_filter, in_filter, slices, sources
from lexloom.llm.components import components

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Chance that registers of different least values agree, for sets of like size (Yu and Weber).
COLLISION = 0.169919487159739 * 2.0 ** (1 - MANTISSA)
#: Word hashes that a worker keeps.
CACHE = 300_000

_rng = np.random.default_rng(20240611)
_XOR = _rng.integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32)
_ODD = _rng.integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32) | np.uint32(1)
_STEP = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of 64-bit shingle hashes."""

    def __init__(self, n: int) -> None:
        self.n, self.known = n, {}

    def shingles(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        hashed = [known.get(w) for w in words]
        if None in hashed:
            for k, h in enumerate(hashed):
                if h is None:
                    hashed[k] = known[words[k]] = xxhash.xxh3_64_intdigest(words[k])
        h, n = np.array(hashed, np.uint64), min(self.n, len(words))
        out, factor = np.zeros(len(h) - n + 1, np.uint64), 1
        for k in range(n):
            out += h[n - 1 - k : len(h) - k] * np.uint64(factor)
            factor = factor * _STEP % (1 << 64)
        return np.unique(_mix(out + np.uint64(n)))


def key_of(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def registers(shingles: np.ndarray) -> np.ndarray:
    """16 bits for each hash function: leading zeros of the least value, and the bits after its first one."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(high), 1024):
        np.minimum(least, ((high[k : k + 1024, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    fraction, exponent = np.frexp(least.astype(np.float64) + 1.0)
    return (((33 - exponent) << MANTISSA) | ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)).astype("<u2")


def bands(sketch: np.ndarray) -> list[int]:
    raw = sketch.tobytes()
    return [xxhash.xxh3_64_intdigest(raw[2 * ROWS * b : 2 * ROWS * (b + 1)], seed=b) - (1 << 63) for b in range(BANDS)]


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity from the share of equal registers, less what chance alone makes equal."""
    return max(0.0, (float(np.mean(a == b)) - COLLISION) / (1 - COLLISION))


def text_hash() -> F.Column:
    """Tells rows of one doc_id apart that have different texts."""
    return F.xxhash64("text")


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in slices(batches):
            keys, sizes, found = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingler.shingles(text)
                sizes.append(len(s))
                keys.append(key_of(s))
                found.append(bands(registers(s)) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "key", "bands"])

    return run


def _features(n: int, bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in slices(batches):
            keys, regs, sets = [], [], []
            for text in batch.column(0).to_pylist():
                s = shingler.shingles(text)
                key = key_of(s)
                if in_filter(bits, key):
                    keys.append(key)
                    regs.append(registers(s).tobytes())
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(regs, pa.binary()), pa.array(sets, pa.binary())], ["key", "regs", "shingles"])

    return run


def _near(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            a, b, x, y = [c.to_pylist() for c in batch.columns]
            keep = [k for k in range(len(a)) if estimate(np.frombuffer(x[k], "<u2"), np.frombuffer(y[k], "<u2")) >= floor]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.string()), pa.array([b[k] for k in keep], pa.string())], ["a", "b"])

    return run


def is_linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    both = len(one) + len(two) - len(np.unique(np.concatenate([one, two])))
    return 100 * both >= percent * (len(one) + len(two) - both)


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [(a, b) for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns]) if is_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.string()), pa.array([k[1] for k in keep], pa.string())], ["a", "b"])

    return run


def prefix_size(own: int, pivot: int, apart: int, linked: bool, percent: int) -> int:
    """How many of the elements that a set and its pivot do not share must be looked at.

    The least overlap with any set that can be linked to this one: a set linked to the pivot meets only sets that are not.
    """
    r = (100 - percent) / (100 + percent)
    floor = apart + r * (pivot - own) if linked else apart - r * (own + pivot)
    overlap = max(1, int(np.ceil(floor / 2 - 1e-9)))
    return max(0, apart - overlap + 1)


_AGAINST = {"pivot": pa.string(), "key": pa.string(), "linked": pa.bool_(), "size": pa.int64(), "apart": pa.int64(), "first": pa.int64(), "elements": pa.list_(pa.int64())}


def _against_pivot(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                pivot, own = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                apart, linked = np.setxor1d(pivot, own, assume_unique=True), is_linked(pivot, own, percent)
                rows.append((a, b, linked, len(own), len(apart), prefix_size(len(own), len(pivot), len(apart), linked, percent), apart.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(_AGAINST), _AGAINST.values())], list(_AGAINST))

    return run


def prefixes(rest: DataFrame, kept: Scratch) -> DataFrame:
    """pivot, key, linked, size, apart, element, place: the first elements of each set, those that fewer sets have first.

    Elements of one set alone make no pair; they only take the first places.
    """
    every = kept.save(rest.select("pivot", "key", "linked", "size", "apart", "first", F.explode("elements").alias("element")), "elements")
    often = every.groupBy("pivot", "element").agg(F.count("*").alias("often")).where("often > 1")
    every = every.join(often.hint("merge"), ["pivot", "element"])
    own = Window.partitionBy("pivot", "key")
    place = F.col("apart") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "element")) - 1
    return every.withColumn("place", place).where("place < first").drop("first", "often")


def links(docs: DataFrame, sketches: DataFrame, kept: Scratch, n: int, percent: int) -> DataFrame:
    """a, b: links between sets (by key) that connect the same sets as all links do."""
    nodes = sketches.where("n_shingles > 0").groupBy("key").agg(F.first("bands").alias("bands"))
    held = kept.save(nodes.select("key", F.explode("bands").alias("band")), "bands")
    shared = held.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = kept.save(held.join(shared.hint("merge"), "band"), "members")
    kept.drop("bands")
    degree = kept.save(members.groupBy("key").agg(F.sum("n").alias("degree")), "degree")
    bits = bit_filter(degree.select("key"))
    features = sources(docs, "text").mapInArrow(_features(n, bits), "key string, regs binary, shingles binary")
    features = features.groupBy("key").agg(F.first("regs").alias("regs"), F.first("shingles").alias("shingles")).join(degree.select("key").hint("merge"), "key", "left_semi")
    features = kept.save(features, "features")
    sketched, sets = features.select("key", "regs"), features.select("key", "shingles")

    def joined(pairs: DataFrame, a: str, b: str, table: DataFrame, value: str) -> DataFrame:
        for side in (a, b):
            pairs = pairs.join(table.select(F.col("key").alias(side), F.col(value).alias(f"{value}_{side}")).hint("merge"), side)
        return pairs.select(a, b, f"{value}_{a}", f"{value}_{b}")

    ranked = members.join(degree.hint("merge"), "key")
    pivots = ranked.groupBy("band").agg(F.max(F.struct("degree", "key")).alias("p")).select("band", F.col("p.key").alias("pivot"))
    meet = members.select("band", "key").join(pivots.hint("merge"), "band").where("key <> pivot").select("pivot", "key").distinct()
    done = joined(meet, "pivot", "key", sets, "shingles").mapInArrow(_against_pivot(percent), "pivot string, key string, linked boolean, size long, apart long, first long, elements array<long>")
    done = kept.save(done, "pivots")
    apart = done.where("not linked").select("pivot").distinct()
    rest = kept.save(prefixes(done.join(apart.hint("merge"), "pivot", "left_semi"), kept), "prefixes")
    one = rest.where("not linked").select("pivot", "element", *[F.col(c).alias(f"{c}_one") for c in ("key", "size", "apart", "place")])
    two = rest.select("pivot", "element", "linked", *[F.col(c).alias(f"{c}_two") for c in ("key", "size", "apart", "place")])
    # At the first element in common, what is left of either D must still hold the overlap that a link needs.
    left = F.least(F.expr("apart_one - place_one"), F.expr("apart_two - place_two"))
    enough = 2 * (100 + percent) * left >= (100 + percent) * F.expr("apart_one + apart_two") - (100 - percent) * F.expr("size_one + size_two")
    alike = 100 * F.least("size_one", "size_two") >= percent * F.greatest("size_one", "size_two")
    pairs = one.join(two.hint("merge"), ["pivot", "element"]).where("key_one <> key_two and (linked or key_one < key_two)").where(enough & alike)
    pairs = pairs.select(F.col("key_one").alias("one"), F.col("key_two").alias("two"))
    pairs = kept.save(pairs.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct(), "pairs")
    floor = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
    near = kept.save(joined(pairs, "a", "b", sketched, "regs").mapInArrow(_near(floor), "a string, b string"), "near")
    found = joined(near, "a", "b", sets, "shingles").mapInArrow(_linked(percent), "a string, b string")
    return kept.save(done.where("linked").select(F.col("pivot").alias("a"), F.col("key").alias("b")).unionByName(found), "links")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and text_hash for every document."""
    kept = Scratch(docs.sparkSession, "minhash")
    sketches = kept.save(sources(docs, "doc_id", "text").withColumn("text_hash", text_hash()).mapInArrow(_sketch(n), "doc_id long, text_hash long, n_shingles long, key string, bands array<long>"), "sketches")
    found = links(docs, sketches, kept, n, percent)
    roots = components(found, kept)
    rows = sketches.select("doc_id", "text_hash", "n_shingles", "key").join(roots.select(F.col("node").alias("key"), "root").hint("merge"), "key", "left")
    rows = kept.save(rows.select("doc_id", "text_hash", "n_shingles", F.coalesce("root", "key").alias("root")), "rows")
    least = rows.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = rows.join(least.hint("merge"), "root", "left")
    of = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", of.alias("component_id"), F.col("doc_id").eqNullSafe(of).alias("kept"), "text_hash")
