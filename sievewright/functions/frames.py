"""Frames: reliable cuts of lineage, and running sums over groups of any size."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which executors share; set from spark.checkpoint.dir.

    In local mode, where there is one machine, a temporary folder stands in for one that isn't set. A cluster must name
    its own: executors can't share a folder of one machine.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: A table of fewer bytes may be one row group, which one task reads whole.
SMALL_BYTES = 16 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; a small one is dealt out to all cores, a larger one stays in the splits of its scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES
    return df.repartition(spark.sparkContext.defaultParallelism) if small else df


def running_sum(df: DataFrame, name: str, value: Column, group: list[str], bucket: Column, order: list) -> DataFrame:
    """Adds the sum of value over the rows of the group before each row (exclusive).

    The bucket must never fall along the order. Buckets are summed first, then rows are summed inside their bucket, so
    no task holds more than one bucket of rows, or a row for each bucket of a group.
    """
    keyed = df.withColumns({"__value": value.cast("bigint"), "__bucket": bucket})
    sums = keyed.groupBy(*group, "__bucket").agg(F.sum("__value").alias("__inside"))
    ahead = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)], F.col("__bucket").alias("__b"), F.coalesce(F.sum("__inside").over(ahead), F.lit(0)).alias("__start"))
    inner = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.withColumn("__before", F.coalesce(F.sum("__value").over(inner), F.lit(0)))
    same = F.col("__bucket").eqNullSafe(F.col("__b"))  # by itself where there is no group
    for k, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{k}"))
    out = rows.join(starts, same).withColumn(name, F.col("__start") + F.col("__before"))
    return out.drop("__value", "__bucket", "__inside", "__before", "__start", "__b", *[f"__g{k}" for k in range(len(group))])
