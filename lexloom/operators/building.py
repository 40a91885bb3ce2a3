"""The loop that grows a lexicon: rounds of candidates, verdicts and imports until nothing new stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.sources.shared import shared_folder

#: Words taken up in a round; rounds at most; rounds without a gain after which it ends.
TAKEN, ROUNDS, DRY = 24, 8, 2


def converge(spark: SparkSession, sf_dir: str, most: int = TAKEN, rounds: int = ROUNDS) -> DataFrame:
    """round, taken, covered, tokens: how much of the texts the words taken up so far cover after each round.

    The vocabulary is counted once and written to the shared folder; every round reads that table, and the words taken
    so far are few (most times rounds). A round takes the most frequent words of three or more letters that are left. It
    ends with the pool: a round that finds fewer words than it may take is the last.
    """
    folder = shared_folder(spark, "converge")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.select(F.explode(T.tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{folder}/terms")
    terms = spark.read.schema("term string, n long").parquet(f"{folder}/terms")
    total = terms.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    taken: list[tuple[str, int]] = []
    rows, dry = [], 0
    for turn in range(1, rounds + 1):
        left = terms.where(~F.col("term").isin([t for t, _ in taken]) & (F.length("term") >= 3)) if taken else terms.where(F.length("term") >= 3)
        new = [(r.term, r.n) for r in left.orderBy(F.desc("n"), "term").limit(most).collect()]
        taken += new
        rows.append((turn, len(taken), sum(n for _, n in taken), total))
        dry = 0 if new else dry + 1
        if dry == DRY or len(new) < most:
            break
    return spark.createDataFrame(rows, "round int, taken int, covered long, tokens long")
