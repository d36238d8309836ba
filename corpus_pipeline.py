"""Documents to training tokens: quality, near-duplicates, personal data, mixture, byte-level BPE.

A stage takes the rows that its predecessor kept, and all but the last give the columns of documents and no others.
Between stages the rows stand in Parquet files, in the shared folder in run(), so each stage's work is done once, and a
lost executor costs its tasks only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sievewright.functions.frames import shared_folder
from sievewright.llm import bpe, curriculum, pii, quality, similar
from sievewright.llm._batches import table
from sievewright.llm.queries import BYTE_VOCABULARY
from sievewright.sources.readers import numbered


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores 0.5 or more, as they are.

    A null or empty text has a score like any other; rows of one text stay or go together; without labels all stay; no
    column but text is an input of a score; an empty table gives an empty one.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that SimHash within its radius or five-word similarity of 0.8 joins: the smallest doc_id's.

    Texts without words, null ones too, are one group; a null doc_id stays only where its group has no other; of rows
    that repeat a doc_id one stays, the same in every run; columns are kept; an empty table gives an empty one.
    """
    return similar.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each piece of personal data in text replaced by its kind in brackets, and n_chars counted again.

    Null and empty texts stay so; whole texts are searched, whatever their length; other columns are kept.
    """
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in training order over files and the rows inside them.

    Documents without words are never taken; a null source is a source; rows that repeat are documents of their own.
    """
    return curriculum.mix(docs, "__sw_position", "__sw_pass").drop("__sw_position", "__sw_pass")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position, n_tokens, ids, ids_sha256, decoded_sha256 of each row.

    position is the row's place in training order: that of its file and of the row in it, which tells readings of one
    document apart; null where the rows don't come straight from files. A null text is the empty one, without ids.
    """
    try:
        placed = numbered(docs, "position")
    except AnalysisException:
        placed = docs.withColumn("position", F.lit(None).cast("bigint"))
    return bpe.encode_documents(placed, BYTE_VOCABULARY, with_ids=True, keep=["position"])


STAGES = [("quality", good), ("near_duplicates", distinct), ("pii", private), ("mixture", mixed), ("bpe", encoded)]

#: A fitted network and byte-level merges are not for SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before it gives is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
