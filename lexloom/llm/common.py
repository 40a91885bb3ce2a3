"""What the operators of this package share: scratch tables, word splitting, long running sums."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall
#: Most rows of an Arrow batch.
BATCH = 1000


def sources(table: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns never clash with what an operator adds."""
    return table.select(*[F.col(f"`{n}`").alias(n) for n in names])


def fresh(columns: list[str], name: str) -> str:
    """The name, or one with more underscores, that none of the columns has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_columns(table: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """mapInArrow for columns of any name, such as ones with points."""
    plain = [f"c{k}" for k in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, plain)

    kinds = T.StructType([T.StructField(p, f.dataType, f.nullable) for p, f in zip(plain, schema.fields)])
    return table.toDF(*[f"c{k}" for k in range(len(table.columns))]).mapInArrow(renamed, kinds).toDF(*schema.names)


class Scratch:
    """Tables under spark.checkpoint.dir, which every executor shares; each object has a folder of its own.

    Where the setting is empty, a temporary folder takes its place in local tests; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set")
            top = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        # Rows hold whole texts: fewer of them at a time keep what a worker holds small.
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
        self.spark, self.top = spark, f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.top}/{name}"

    def save(self, table: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write the table and read it again: cuts lineage and survives lost executors."""
        table.write.option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(table.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what Python makes of one stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


#: Bits of a key filter: 2 MB, however many keys there are.
FILTER_BITS = 1 << 24


def bit_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit set for each hexadecimal key, by its first digits. Of bounded size; a full filter lets everything pass."""
    place = F.pmod(F.conv(F.substring("key", 1, 12), 16, 10).cast("long"), F.lit(bits))
    found = keys.select(place.alias("place")).groupBy(F.shiftright("place", 5).alias("word"))
    found = found.agg(F.expr("bit_or(shiftleft(1L, cast(place % 32 as int)))").alias("mask")).toPandas()
    out = np.zeros(bits >> 5, np.uint32)
    out[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).astype(np.uint32)
    return out


def in_filter(bits: np.ndarray, key: str) -> bool:
    place = int(key[:12], 16) % (32 * len(bits))
    return bool(int(bits[place >> 5]) >> (place & 31) & 1)


def running_sum(table: DataFrame, group: list[str], order: list[Column], bucket: Column, value: Column, name: str) -> DataFrame:
    """Adds the sum of value over all earlier rows of the group, without bringing a whole group to one task.

    bucket must not fall as the order rises. Sums by bucket are added up first (few rows), then each
    bucket is ordered by itself. Null groups count as a group.
    """
    cut, part, before = "__bucket", "__part", "__before"
    table = table.withColumn(cut, bucket)
    keys = [F.col(g) for g in group]
    sums = table.groupBy(*group, cut).agg(F.sum(value).alias(part))
    sums = sums.withColumn(before, F.sum(part).over(Window.partitionBy(*keys).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(cut).alias("__cut"), F.coalesce(before, F.lit(0)).alias(before))
    on = F.col(cut) == F.col("__cut")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    inner = Window.partitionBy(*keys, F.col(cut)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # The hint keeps Spark from sending either side, which grows with the data, to every executor.
    out = table.withColumn(part, F.coalesce(F.sum(value).over(inner), F.lit(0))).join(sums.hint("merge"), on)
    return out.withColumn(name, F.col(part) + F.col(before)).drop(cut, part, before, "__cut", *[f"__{g}" for g in group])
