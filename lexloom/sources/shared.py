"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is not set, as in local tests, a temporary one.

    On a cluster the setting must be there: a folder of one machine would be empty on all others.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        top = "file://" + tempfile.mkdtemp(prefix="lexloom-")
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(table: DataFrame, what: str) -> DataFrame:
    """The table, written once to a shared folder and read from there by all that use it."""
    spark = table.sparkSession
    path = shared_folder(spark, what)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
