"""Run metadata: presets, schedules, retention, loss logs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import constants as K


def presets(spark: SparkSession) -> DataFrame:
    """Preset table with intermediate size (8/3 of the hidden size, up to a multiple of 256) and parameter count."""
    rows = spark.createDataFrame(K.PRESETS, "name string, layers bigint, hidden bigint, heads bigint, kv_heads bigint, vocab bigint")
    sized = rows.withColumn("intermediate", (F.floor((F.floor(F.col("hidden") * 8 / 3) + 255) / 256) * 256).cast("bigint"))
    head = F.floor(F.col("hidden") / F.col("heads"))
    h, i = F.col("hidden"), F.col("intermediate")
    block = 2 * h + h * F.col("heads") * head + 2 * h * F.col("kv_heads") * head + h * h + 3 * h * i
    return sized.withColumn("parameters", (F.col("vocab") * h + F.col("layers") * block + h).cast("bigint"))


def preset(spark: SparkSession, name: str) -> DataFrame:
    if name not in {p[0] for p in K.PRESETS}:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(p[0] for p in K.PRESETS)}")
    return presets(spark).filter(F.col("name") == name)


def checked(shapes: DataFrame) -> DataFrame:
    """The rows; a task fails on heads that don't divide the hidden size, or groups that don't divide the heads."""
    fault = F.when(F.col("hidden") % F.col("heads") != 0, F.lit("hidden size isn't a multiple of heads")).when(F.col("heads") % F.col("kv_heads") != 0, F.lit("heads aren't a multiple of key-value heads"))
    return shapes.filter(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True)))


def learning_rates(spark: SparkSession, highest: float, lowest: float, warmup: int, steps: int) -> DataFrame:
    """(step, rate): a line that reaches the highest at the end of the warm-up, then half a cosine down."""
    s = F.col("id")
    past = (s - warmup) / float(max(1, steps - warmup))
    cosine = lowest + (highest - lowest) * 0.5 * (1 + F.cos(math.pi * past))
    rate = F.when(s < warmup, highest * (s + 1) / float(max(1, warmup))).otherwise(cosine)
    return spark.range(steps).select(F.col("id").alias("step"), rate.cast("double").alias("rate"))


def expired(listing: DataFrame, keep: int = 2) -> DataFrame:
    """Checkpoints (name, mtime) beyond the newest; finals never expire, and keep = 0 keeps all."""
    steps = listing.filter(F.col("name").startswith("step_") & ~F.contains("name", F.lit("_final")))
    ranked = steps.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("mtime"), F.desc("name"))))
    return ranked.filter((F.col("__r") > keep) & (F.lit(keep) > 0)).drop("__r")


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """step, train, val of loss logs, each a JSON array; a file that can't be read counts as empty."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema("step bigint, train double, val double").json(path)
    return rows.filter(F.col("step").isNotNull())


def append_losses(rows: DataFrame, path: str) -> None:
    """One more file of the log, a JSON array rounded to six places; readers take the whole folder. Rows of one append are few."""
    rounded = F.struct("step", F.round("train", 6).alias("train"), F.round("val", 6).alias("val"))
    rows.agg(F.to_json(F.array_sort(F.collect_list(rounded))).alias("value")).write.mode("append").text(path)


def mean_loss(rows: DataFrame, last: int = 10) -> DataFrame:
    newest = rows.orderBy(F.desc("step")).limit(last)
    return newest.agg(F.avg("train").alias("train"), F.avg("val").alias("val"))


def with_maturity(runs: DataFrame, least: int = 15_000) -> DataFrame:
    return runs.withColumn("immature", F.col("step") < least)
