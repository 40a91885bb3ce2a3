"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations alone.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, 5, ... and share ``share`` times all words; a target
stops at ``repeats`` times its source's words and the excess goes to the others by weight.

Schedule. Slot t takes the point frac((t + 1/2) / phi) of the golden-ratio sequence; the source in whose interval of
the cumulative targets the point falls supplies the slot. The k-th slot of a source takes the k-th block of
``block`` words of its stream: its documents in the order of a seeded digest, twice over.

Nulls: a null text has size 0, a null source is a source of its own; a null doc_id is an ordinary row. Documents
without words are taken 0 times. Repeated rows are separate documents. An empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, running_sum, sources

#: frac(1 / phi)
GOLDEN = 0.6180339887498949
WEIGHTS = (5, 2, 1)
BLOCK = 128
#: Fewest cells in which slots look for their source.
CELLS = 1024


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and text_hash, which tells rows of one doc_id apart that have different texts."""
    return sources(docs, "doc_id", "source", "text").select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long")).alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """source, source_size, weight, target: one row for each source.

    Water filling in closed form: with sources by cap / weight, a source stops at its cap if that ratio is at most
    what remains for it and all later ones, divided by their weights.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*map(F.lit, weights))
    by = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    by = by.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    up = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    by = by.withColumns({
        "total": F.sum("source_size").over(Window.partitionBy()) * F.lit(share),
        "filled": F.coalesce(F.sum("source_size").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * repeats,
        "heavy": F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)),
    })
    by = by.withColumn("level", (F.col("total") - F.col("filled")) / F.col("heavy"))
    by = by.withColumn("capped", F.col("source_size") * repeats <= F.col("level") * F.col("weight"))
    free = F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), "rank", "level"))).over(Window.partitionBy())
    by = by.withColumn("free", free)
    at_cap = F.col("free").isNull() | (F.struct((F.col("source_size") / F.col("weight")).alias("r"), "rank") < F.struct("free.r", "free.rank"))
    cap = (F.col("source_size") * repeats).cast("double")
    return by.select("source", "source_size", "rank", "weight", F.when(at_cap, cap).otherwise(F.least(cap, F.col("free.level") * F.col("weight"))).alias("target"))


def schedule(goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source, number: which block of which source each slot of the mix takes, slots from 0."""
    spark = goal.sparkSession
    ends = goal.select("source", "rank", F.sum("target").over(Window.orderBy("rank")).alias("upto"))
    number, total = ends.agg(F.count("*"), F.max("upto")).first()
    total = total or 0.0
    slots = math.ceil(total / block)
    # Slots and sources meet by cells of the unit interval, of which there are a few for each source, so that a slot
    # meets one source or two on average, however many sources there are and however unlike their targets.
    cells = max(CELLS, 4 * number)
    low = F.coalesce(F.lag("upto").over(Window.orderBy("rank")), F.lit(0.0))
    cell = lambda x: F.floor(x / F.lit(total or 1.0) * cells)
    bounds = ends.withColumn("low", low).where("low < upto")
    bounds = bounds.select("source", "low", F.when(F.col("upto") < total, F.col("upto")).otherwise(F.lit(math.inf)).alias("upto"), F.explode(F.sequence(cell(F.col("low")) - 1, cell(F.col("upto")) + 1)).alias("cell"))
    point = (F.col("slot").cast("double") + 0.5) * F.lit(GOLDEN)
    dealt = spark.range(slots).withColumnRenamed("id", "slot").withColumn("unit", point - F.floor(point))
    dealt = dealt.select("slot", (F.col("unit") * total).alias("point"), F.floor(F.col("unit") * cells).alias("cell"))
    dealt = dealt.join(bounds, "cell").where("low <= point and point < upto").select("slot", "source")
    return running_sum(dealt, ["source"], [F.col("slot")], F.shiftright("slot", 16), F.lit(1), "number")


def stream(sizes: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds start: the words of the source's documents that come before this one in its shuffled stream."""
    # Without a doc_id the digest of the empty id decides; what still ties is ordered by size.
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    ranked = sizes.withColumn("__digest", digest)
    return running_sum(ranked, ["source"], [F.col("__digest"), F.col("doc_id"), F.col("size"), F.col("text_hash")], F.substring("__digest", 1, 3), F.col("size"), "start").drop("__digest")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2, block: int = BLOCK, seed: str = "mix") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with their place in the streams, the targets, and the mix itself.

    The mix has a row for each slot and each document that its block touches: slot, source, doc_id, row, copy (0 for
    the first pass over the source), offset and words (which words of the document).
    """
    kept = Scratch(docs.sparkSession, "mix")
    sizes = kept.save(sized(docs), "sizes")  # texts are read once
    goal = kept.save(targets(sizes, weights, share, repeats), "targets")
    placed = stream(sizes, seed)
    plan = schedule(goal, block)
    total = goal.select(F.col("source").alias("__source"), F.col("source_size").alias("__all"))
    both = placed.where("size > 0").join(total, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    both = both.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    both = both.withColumn("first", F.col("start") + F.col("copy") * F.col("__all"))
    both = both.withColumn("number", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))))
    cut = plan.select(F.col("slot"), F.col("source").alias("__source"), F.col("number").alias("__number"))
    parts = both.join(cut.hint("merge"), (F.col("number") == F.col("__number")) & F.col("source").eqNullSafe(F.col("__source")))
    low, high = F.greatest("first", F.col("number") * block), F.least(F.col("first") + F.col("size"), (F.col("number") + 1) * block)
    return placed, goal, parts.select("slot", "source", "doc_id", "start", "copy", (low - F.col("first")).alias("offset"), (high - low).alias("words"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, start, text_hash, for every document."""
    placed, goal, parts = mix(docs, **options)
    # start tells the documents of a source apart, also those that share a doc_id
    sums = parts.groupBy("source", "start").agg(F.sum("words").alias("taken")).select(F.col("source").alias("__source"), F.col("start").alias("__start"), "taken")
    out = placed.join(goal.select(F.col("source").alias("__goal"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__goal")))
    mine = F.col("source").eqNullSafe(F.col("__source")) & (F.col("start") == F.col("__start")) & (F.col("size") > 0)
    out = out.join(sums.hint("merge"), mine, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "start", "text_hash")
