"""Streams: windowed counts with late data, and the reconciliation ledger as a state machine by occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.sources.shared import shared_folder

LATE, WIDTH = "10 minutes", "1 hour"


def windowed(events: DataFrame) -> DataFrame:
    """Count and sum of values by tumbling window and type; rows later than the watermark are dropped."""
    own = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    by = own.withWatermark("ts", LATE).groupBy(F.window("ts", WIDTH).alias("w"), "event_type")
    out = by.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start_at"), "event_type", "n", "total")


def run_once(out: DataFrame, spark: SparkSession, what: str, mode: str) -> DataFrame:
    """All there is in the stream now, as a table; the last batch of a complete result replaces those before."""
    folder = shared_folder(spark, what)
    path = f"{folder}/table"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    flow = out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    flow.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def st_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return run_once(windowed(events), spark, "windowed", "complete")


#: State of an occurrence: attempts so far and where the last one led.
STATE, CHANGES = "attempts int, state string", "occurrence string, attempt int, state string, fault string"
ENDED = ("accepted", "rejected", "review")


def step(attempts: int, state: str, candidate: str, confidence: float, allowed: list[str]) -> tuple[int, str, str]:
    """Next attempt, state and fault for a response."""
    if state in ENDED:
        return attempts, state, "terminal"
    if attempts >= 2:
        return attempts, state, "exhausted"
    if candidate != "ABSTAIN":
        if candidate not in allowed or not confidence > 0:
            return attempts, state, "invalid"
        return attempts + 1, "accepted", ""
    return attempts + 1, "unresolved" if attempts == 0 else "rejected", ""


def _advance(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    attempts, state = held.get if held.exists else (0, "open")
    rows = []
    # An occurrence has at most two attempts that count, so its rows of one batch are few.
    every = pd.concat(list(frames)).sort_values(["at", "candidate"], kind="stable")
    for r in every.itertuples(index=False):
        attempts, state, fault = step(attempts, state, r.candidate, r.confidence, r.allowed.split(","))
        rows.append((key[0], attempts, state, fault))
    held.update((attempts, state))
    yield pd.DataFrame(rows, columns=["occurrence", "attempt", "state", "fault"])


def ledger(responses: DataFrame) -> DataFrame:
    """occurrence, attempt, state, fault for each response (occurrence, at, candidate, confidence, allowed) of a stream."""
    own = responses.select("occurrence", "at", "candidate", "confidence", "allowed")
    return own.groupBy("occurrence").applyInPandasWithState(_advance, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def st_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as responses: a user is an occurrence, errors abstain."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    answers = events.select(F.col("user_id").cast("string").alias("occurrence"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", F.lit("ABSTAIN")).otherwise(F.col("event_type")).alias("candidate"), (F.col("value") / 1000).alias("confidence"), F.lit("signup,purchase").alias("allowed"))
    return run_once(ledger(answers), spark, "ledger", "append")


QUERIES = {"st_windowed": st_windowed, "st_ledger": st_ledger}
SQL = {
    "st_windowed": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
