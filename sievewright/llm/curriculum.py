"""Mixing sources to target weights along a time-varying curriculum (operator 7). DataFrame functions only.

Sources by code point, null last, have the weights WEIGHTS in turn. The mix is SHARE times all words; a source's target
is its weight times a common level, at most CAP times its words, the excess going to the others by weight. The level
comes from one ordered pass over the sources, of which there is a row each, not a row a document.

Over training time t from 0 to 1 a source's weight follows a line, 1 + tilt * (2t - 1), whose integral is
t + tilt * (t*t - t): heavy sources fall, light ones rise. Within a source, documents stand in the order of a hash,
and a document is read again each time the demand passes the middle of its words: in pass p it is taken if
p * source_size + middle < target. That demand, inverted, is the training position, by which rows are range-sorted.

Running sums over a source of any size take two steps: about sqrt(rows) buckets of the hash, summed first; then the
rows of one bucket. Neither window holds more than about sqrt(rows) rows of a source.

Defined results: a null text has size 0; documents of size 0 are never taken; a null source is a source; rows that
repeat follow each other in any order, which gives the same rows; ties of the hash go by doc_id and size; extra columns
are ignored by plan() and kept by mix(), but for ones of the names that it gives to position and pass; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm._batches import cut

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: How weights move over training, in the order of WEIGHTS.
TILTS = (-0.5, 0.25, 0.75)
#: Fewest buckets of the hash.
BUCKETS = 16


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sums: DataFrame) -> DataFrame:
    """source, source_size, weight, tilt, target from source, source_size: one row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("place") + 1).cast("int"))
    named = sums.withColumn("place", place).withColumns({"weight": pick(WEIGHTS).cast("double"), "tilt": pick(TILTS)}).drop("place")
    full = F.lit(CAP) * F.col("source_size")
    # Sources fill up in this order; those before a row are full when the row's level is asked for.
    filling = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    named = named.withColumns(
        {
            "left": F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(before), F.lit(0)),
            "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "turn": F.row_number().over(filling),
        }
    )
    level = F.col("left") / F.col("open")
    lowest = F.min(F.when(level * F.col("weight") <= full, F.struct("turn", level.alias("level")))).over(every)["level"]
    return named.select("source", "source_size", "weight", "tilt", F.least(full.cast("double"), F.coalesce(lowest * F.col("weight"), full.cast("double"))).alias("target"))


def position(demand: Column, tilt: Column) -> Column:
    """t at which t + tilt * (t*t - t) is the demand; both from 0 to 1, |tilt| < 1."""
    b = F.lit(1.0) - tilt
    return F.when(F.abs(tilt) < 1e-9, demand).otherwise((F.sqrt(b * b + 4 * tilt * demand) - b) / (2 * tilt))


def _places(rows: DataFrame, n: int) -> DataFrame:
    """rows (doc_id, source, size, and others) with source_size, target, tilt, middle, in the order of a hash."""
    buckets = max(BUCKETS, math.isqrt(n))
    keyed = rows.withColumn("__hash", F.xxhash64("doc_id", "size")).withColumn("__bucket", F.pmod("__hash", F.lit(buckets)))
    sums = keyed.groupBy("source", "__bucket").agg(F.sum("size").alias("inside"))
    order = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("inside").over(order), F.lit(0)))
    per_source = targets(sums.groupBy("source").agg(F.sum("inside").alias("source_size")))
    starts = starts.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    starts = starts.select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), "start", "source_size", "target", "tilt")
    within = Window.partitionBy("source", "__bucket").orderBy("__hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("__upto", F.sum("size").over(within))
    joined = placed.join(starts, placed["source"].eqNullSafe(starts["__s"]) & (placed["__bucket"] == starts["__b"]))
    middle = F.col("start") + F.col("__upto") - F.col("size") / F.lit(2.0)
    return joined.withColumn("middle", middle).drop("__hash", "__bucket", "__upto", "__s", "__b", "start")


def _positions() -> Column:
    """Training positions of a row, one for each pass that takes it."""
    demand = lambda p: (F.lit(p) * F.col("source_size") + F.col("middle")) / F.col("target")
    each = [F.when((F.col("size") > 0) & (demand(p) < 1), position(demand(p), F.col("tilt"))) for p in range(CAP)]
    return F.when(F.col("target") > 0, F.array_compact(F.array(*each))).otherwise(F.array().cast("array<double>"))


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, positions of each row, sorted by first position."""
    rows = cut(docs.select("doc_id", "source", words().alias("size")))
    taken = _places(rows, rows.count()).withColumn("positions", _positions())
    out = taken.select("doc_id", "size", "source_size", "target", (F.size("positions") * F.col("size")).cast("bigint").alias("taken"), "positions")
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    return out.repartitionByRange(first, F.col("doc_id")).sortWithinPartitions(first, F.col("doc_id"))


def mix(docs: DataFrame, position: str = "position", reading: str = "pass") -> DataFrame:
    """The same columns, position (0 to 1) and pass (0 for the first reading), or other names; a row for each time that a document is taken.

    Rows are sorted by position over all partitions, the first partition's first.
    """
    names = [n for n in docs.columns if n not in (position, reading)]
    held = docs.select("doc_id", "source", F.struct(*[F.col(f"`{n}`") for n in names]).alias("__row"), words().alias("size"))
    taken = _places(held, docs.count()).select("__row", "doc_id", F.posexplode(_positions()).alias("__pass", "__at"))
    order = ["__at", "doc_id", "__pass"]
    return taken.repartitionByRange(*order).sortWithinPartitions(*order).select("__row.*", F.col("__at").alias(position), F.col("__pass").alias(reading))
