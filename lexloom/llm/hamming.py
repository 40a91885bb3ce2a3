"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each dimension, set where the value is positive (null and NaN are not). Codes are cut
into segments of at most 16 bits, each with an index by its value. For a query the search radius r of the segments
grows from 0: every value at distance r is probed and what is found is verified with its full distance. Two codes at a
distance under segments * (r + 1) are within r in some segment, so the search ends when the k-th verified distance is
less than that, or every code has been seen.

Equal codes are one entry with a bounded list of their least ids. Codes are dealt into blocks and so are queries; each
pair of blocks is searched by itself and the answers merged, so no task holds more than two blocks.

Rows without a vector, or with another number of dimensions than ``dims``, are not indexed and as queries have no
answer. Ties go to the lesser id. A query never finds its own row, but finds others of the same id and code. Fewer
than k rows are returned where the table has no more. Rows without an id are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, slices, sources

SEGMENT = 16
#: Codes and queries of a block.
CODES, QUERIES = 1 << 18, 1 << 12


def codes(values: list, dims: int) -> list[bytes | None]:
    """Codes as bytes, the segments in turn, each of two bytes."""
    out: list[bytes | None] = []
    for v in values:
        if v is None or len(v) != dims:
            out.append(None)
            continue
        bits = np.array([x is not None and x > 0 for x in v], np.uint8)
        bits = np.concatenate([bits, np.zeros(-dims % SEGMENT, np.uint8)])
        out.append(np.packbits(bits).tobytes())
    return out


def _coded(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            got = codes(batch.column(1).to_pylist(), dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["id", "code"])

    return run


def _least(k: int):
    """code, ids: the least k ids of each code that a task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["code", "ids"])
            held.clear()
            return got

        for batch in batches:
            for i, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(code, []).append(i)
            for code, ids in held.items():
                if len(ids) > k:
                    held[code] = sorted(ids)[:k]
            if len(held) > 100_000:
                yield out()
        if held:
            yield out()

    return run


class Index:
    """Segment indexes over distinct codes, given as rows of 16-bit segments, with the rows that each stands for."""

    def __init__(self, table: np.ndarray, rows: np.ndarray) -> None:
        self.table, self.rows, self.m = table, rows, table.shape[1]
        self.order, self.start = [], []
        for s in range(self.m):
            order = np.argsort(table[:, s], kind="stable")
            self.order.append(order)
            self.start.append(np.searchsorted(table[order, s], np.arange((1 << SEGMENT) + 1)))
        self.masks: dict[int, np.ndarray] = {}

    def flips(self, r: int) -> np.ndarray:
        if r not in self.masks:
            self.masks[r] = np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), r)], np.int64)
        return self.masks[r]

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of codes that hold the k nearest rows, and all rows as near as the last of them."""
        n = len(self.table)
        seen, found, far = np.zeros(n, bool), [], []
        for r in range(SEGMENT + 1):
            for s in range(self.m):
                values = int(query[s]) ^ self.flips(r)
                low, high = self.start[s][values], self.start[s][values + 1]
                on = high > low
                low, count = low[on], (high - low)[on]
                if not len(low):
                    continue
                at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
                at = self.order[s][at]
                at = at[~seen[at]]
                seen[at] = True
                if len(at):
                    found.append(at)
                    far.append(np.bitwise_count(self.table[at] ^ query).sum(axis=1))
            sure = self.m * (r + 1) - 1
            every, dist = (np.concatenate(found), np.concatenate(far)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if len(every) == n or self.rows[every[dist <= sure]].sum() >= k:
                break
        order = np.argsort(dist, kind="stable")
        reach = np.cumsum(self.rows[every[order]])
        last = min(int(np.searchsorted(reach, k)), len(order) - 1)
        keep = dist <= dist[order[last]] if len(order) else np.zeros(0, bool)
        return every[keep], dist[keep]


def _segments(found: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, found)), np.uint16).reshape(len(found), -1)


def _cell(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"code": [], "dist": [], "ids": []})
        ids = [list(x) for x in right["ids"]]
        index = Index(_segments(right["code"]), np.array([len(x) for x in ids]))
        out = []
        for code, query in zip(left["code"], _segments(left["code"])):
            hits: list[tuple[int, int]] = []
            for at, d in zip(*index.search(query, k)):
                hits.extend((int(d), i) for i in ids[at])
            hits = sorted(hits)[:k]
            out.append((code, [d for d, _ in hits], [i for _, i in hits]))
        return pd.DataFrame(out, columns=["code", "dist", "ids"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, dims: int = 64) -> DataFrame:
    """query_id, rank, neighbor_id, distance. Both tables have columns id, vector."""
    spark = vectors.sparkSession
    kept = Scratch(spark, "hamming")
    coded = lambda t: sources(t, "id", "vector").where("id is not null").mapInArrow(_coded(dims), "id long, code binary").where("code is not null")
    # One more than asked for: the query's own row may be among them.
    some = k + 1
    gather = lambda t, *by: t.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, some).alias("ids"))
    parts = coded(vectors).mapInArrow(_least(some), "code binary, ids array<long>").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    entries = kept.save(gather(gather(parts, "code", "part"), "code"), "entries")
    asked = kept.save(coded(queries), "asked")
    different = kept.save(asked.select("code").distinct(), "different")
    n, q = entries.count(), different.count()
    across = max(1, math.ceil(n / CODES))
    down = max(1, math.ceil(q / QUERIES), min(spark.sparkContext.defaultParallelism, math.ceil(q / 64)))
    cells = spark.conf.get("spark.sql.shuffle.partitions")
    left = different.select("code", F.pmod(F.xxhash64("code"), F.lit(down)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"))
    right = entries.select("code", "ids", F.pmod(F.xxhash64("code"), F.lit(across)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("q"))
    # The number given, Spark does not put small partitions together: a cell's work follows from both its sides.
    left, right = [t.select(F.col("q").cast("int"), F.col("c").cast("int"), *[x for x in t.columns if x not in "qc"]).repartition(int(cells), "q", "c") for t in (left, right)]
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(_cell(some), "code binary, dist array<long>, ids array<long>")
    hits = found.groupBy("code").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("dist", "ids")))), 1, some).alias("hits"))
    hits = kept.save(hits, "hits")
    every = asked.join(hits.hint("merge"), "code")
    # Its own row is one at distance 0 with its id; without it, the last of the k + 1 is one too many.
    own = F.array_position("hits", F.struct(F.lit(0).cast("long").alias("dist"), F.col("id").alias("ids")))
    rest = F.when(own > 0, F.concat(F.slice("hits", 1, (own - 1).cast("int")), F.slice("hits", (own + 1).cast("int"), some))).otherwise(F.slice("hits", 1, k))
    rows = every.select(F.col("id").alias("query_id"), F.posexplode(rest).alias("at", "hit"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.ids").alias("neighbor_id"), F.col("hit.dist").cast("int").alias("distance"))
