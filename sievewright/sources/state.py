"""Progress and duplicate state of a build, as tables and one small file; nothing is pickled."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sievewright.functions.constants import SOURCE_CATALOG


@dataclass
class Progress:
    completed_sources: list[str] = field(default_factory=list)
    failed_sources: list[str] = field(default_factory=list)
    chunk_idx: int = 0
    total_tokens: int = 0
    tokens_per_source: dict[str, int] = field(default_factory=dict)
    #: State tables of this build that count; others are leftovers of a run that broke off.
    batches: list[str] = field(default_factory=list)


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def load_progress(spark: SparkSession, path: str) -> Progress:
    """What the file says; fields that it lacks have their defaults, and so has everything without a file."""
    place, store, _ = _file(spark, path)
    if not store.exists(place):
        return Progress()
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    known = {k: v for k, v in json.loads(text).items() if k in Progress.__dataclass_fields__ and v is not None}
    return Progress(**known)


def save_progress(spark: SparkSession, path: str, progress: Progress) -> None:
    """Written beside its place and then moved there, so a reader sees the old file or the new one."""
    place, store, jvm = _file(spark, path)
    beside, *_ = _file(spark, f"{path}.new")
    out = store.create(beside, True)
    out.write(bytearray(json.dumps(asdict(progress), indent=2).encode()))
    out.close()
    if store.exists(place):
        store.delete(place, False)
    store.rename(beside, place)


def progress_frame(spark: SparkSession, progress: Progress) -> DataFrame:
    row = [(progress.completed_sources, progress.chunk_idx, progress.total_tokens, progress.tokens_per_source)]
    return spark.createDataFrame(row, "completed_sources array<string>, chunk_idx int, total_tokens bigint, tokens_per_source map<string,bigint>")


def read_if_there(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(*paths)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def catalog(spark: SparkSession) -> DataFrame:
    """source, target, text_field, source_rank."""
    rows = [(n, t, f, k) for k, (n, t, f) in enumerate(SOURCE_CATALOG)]
    return spark.createDataFrame(rows, "source string, target bigint, text_field string, source_rank int")


def remaining_sources(spark: SparkSession, progress: Progress) -> DataFrame:
    done = spark.createDataFrame([(s,) for s in progress.completed_sources], "source string")
    return catalog(spark).join(F.broadcast(done), "source", "left_anti")
