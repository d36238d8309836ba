"""Sources as they land: files of any format that Spark reads, to (source, source_rank, seq, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions.frames import running_sum
from sievewright.sources.state import catalog

COLUMNS = ["source", "source_rank", "seq", "text"]
#: Files of which a number each may be broadcast.
FILES = 100_000


def numbered(rows: DataFrame, name: str = "seq") -> DataFrame:
    """Adds the row's number, from 0 in the order of files and of rows inside a file; rows come straight from a file scan.

    Where files number their rows (Parquet), the rows of each file are counted, a row a file, and no row of at most FILES
    files moves. Elsewhere the splits of files are counted first, so no task holds more than the rows of one, or a row for each.
    """
    fields = {f.name for f in rows.select("_metadata").schema[0].dataType.fields}
    if "row_index" in fields:
        file = F.col("_metadata.file_path")
        counts = rows.select(file.alias("__file")).groupBy("__file").agg(F.count("*").alias("__n"))
        before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select(F.col("__file").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
        if len(rows.inputFiles()) <= FILES:
            starts = F.broadcast(starts)
        placed = rows.withColumns({"__file": file, "__row": F.col("_metadata.row_index")})
        return placed.join(starts, F.col("__file") == F.col("__of")).withColumn(name, F.col("__start") + F.col("__row")).drop("__file", "__row", "__of", "__start")
    split = F.concat("_metadata.file_path", F.lit("#"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    placed = rows.withColumns({"__split": split, "__row": F.monotonically_increasing_id()})
    return running_sum(placed, name, F.lit(1), [], F.col("__split"), ["__row"]).drop("__split", "__row")


def load(spark: SparkSession, path: str, source: str, rank: int = 0, text_field: str = "text", kind: str = "parquet") -> DataFrame:
    """One source of files that Spark reads: parquet, orc, json (a row a line), csv (with a header) or text (a row a line).

    A text that isn't a string, or is absent, counts as none and is skipped later, as a blank one is.
    """
    reader = spark.read.option("header", True).option("multiLine", kind == "csv").option("escape", '"') if kind == "csv" else spark.read
    rows = reader.format(kind).load(path)
    text_field = "value" if kind == "text" else text_field
    text = F.col(f"`{text_field}`") if dict(rows.dtypes).get(text_field) == "string" else F.lit(None).cast("string")
    return numbered(rows.select(text.alias("text"), "_metadata")).select(F.lit(source).alias("source"), F.lit(rank).alias("source_rank"), "seq", "text")


def load_catalog(spark: SparkSession, folder: str, present: list[str], kind: str = "parquet") -> dict[str, DataFrame]:
    """Sources of the catalog in its order, each from the subfolder of its name; present: those that have landed."""
    order = catalog(spark).orderBy("source_rank").collect()
    return {r.source: load(spark, f"{folder}/{r.source}", r.source, r.source_rank, r.text_field, kind) for r in order if r.source in present}


def write_corpus(rows: DataFrame, path: str, text: str = "piece") -> None:
    """Lines of text for a tokenizer; texts keep their own line ends. Files stand for one file in order of names."""
    rows.select(F.col(text).alias("value")).write.mode("overwrite").text(path)
