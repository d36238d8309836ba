"""The cascade over files as they arrive: each micro-batch is judged, deduplicated against the state, and committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions.constants import Thresholds
from sievewright.functions.frames import cut
from sievewright.operators import gates
from sievewright.plans.build import EXACT, SIGNATURES, new_documents
from sievewright.sources.state import read_if_there

#: Batches after which the state of all batches so far is written as one table.
COMPACT = 16


def judge_stream(docs: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Measures and reasons of a stream; the same expressions as in batch, without state."""
    return gates.with_reason(gates.arrived(docs), "text", limits)


def run_available(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, limits: Thresholds = Thresholds(), files: int = 1000) -> None:
    """Takes all files of the folder that no earlier run took: kept rows to out/kept, reasons to out/rejected.

    Every batch writes a folder of its own number, so a batch that is repeated replaces what it wrote. It reads only
    the state of batches before it, as partitions of one table; every COMPACT batches they are written as one.
    """

    def commit(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        exact, signatures = (_before(session, f"{out}/state/{name}", number, schema) for name, schema in (("exact", EXACT), ("signatures", SIGNATURES)))
        judged = cut(gates.with_reason(gates.arrived(batch), "text", limits))
        passed = judged.filter(F.col("reason").isNull())
        marked = cut(new_documents(passed, exact, signatures))
        name = f"{number:08d}"
        marked.filter(F.col("dup_reason").isNull()).select("seq", "clean_text").write.mode("overwrite").parquet(f"{out}/kept/{name}")
        late = marked.filter(F.col("dup_reason").isNotNull()).select("seq", F.col("dup_reason").alias("reason"))
        judged.filter(F.col("reason").isNotNull()).select("seq", "reason").unionByName(late).write.mode("overwrite").parquet(f"{out}/rejected/{name}")
        new = marked.select("exact_hash").distinct(), marked.filter(F.col("dup_reason").isNull()).select("id", "signature")
        for kind, rows, old in (("exact", new[0], exact), ("signatures", new[1], signatures)):
            whole = number % COMPACT == COMPACT - 1
            (rows.union(old) if whole else rows).write.mode("overwrite").parquet(f"{out}/state/{kind}/whole={str(whole).lower()}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _before(spark: SparkSession, path: str, number: int, schema: str) -> DataFrame:
    """State of the batches before this one: the last table of all, and those after it."""
    last = number - number % COMPACT - 1
    kept = read_if_there(spark, [path], f"{schema}, whole boolean, batch int")
    return kept.filter(((F.col("batch") == last) & F.col("whole")) | ((F.col("batch") > last) & (F.col("batch") < number))).drop("whole", "batch")
