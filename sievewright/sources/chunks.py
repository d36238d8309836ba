"""Headerless files of 16-bit token ids: a scan, a Python data source that writes them, and their listing.

A chunk is never a row: it comes and goes as parts (chunk_id, offset, tokens), so that a chunk of any size takes the
memory of a part. The writer appends the parts of a chunk to its file, one task a chunk.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PATTERN = "chunk_*.bin"
#: Tokens of a part, at most.
PART = 1 << 16


def _found(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files in few tasks: a scan counts 4 MB for each, so two or some dozens of small ones would be one."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).option("recursiveFileLookup", True).load(path)
    return found.coalesce(4 * spark.sparkContext.defaultParallelism)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, chunk_id, n_tokens of each chunk file, in shard folders too; contents aren't read."""
    found = _found(spark, path)
    number = F.regexp_extract("path", r"chunk_(\d+)\.bin$", 1).cast("bigint")
    return found.select("path", number.alias("chunk_id"), F.floor(F.col("length") / 2).cast("bigint").alias("n_tokens"))


def resume_point_frame(spark: SparkSession, path: str) -> DataFrame:
    """tokens_done in the chunk files that are there, and next_chunk, the number of the next one."""
    return files(spark, path).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens_done"), F.count("*").alias("next_chunk"))


def resume_point(spark: SparkSession, path: str) -> tuple[int, int]:
    return tuple(resume_point_frame(spark, path).first())


def unpacked(content) -> Column:
    """Tokens of little-endian 16-bit contents, by way of hexadecimal digits."""
    digits = F.hex(content)
    at = lambda i, k: F.instr(F.lit("0123456789ABCDEF"), F.substring(digits, 4 * i + k, F.lit(1))) - 1
    one = lambda i: (at(i, 1) * 16 + at(i, 2) + (at(i, 3) * 16 + at(i, 4)) * 256).cast("int")
    n = F.floor(F.length(content) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<int>"))


def read(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """chunk_id, offset, tokens: the files in parts of at most so many tokens."""
    import numpy as np

    raw = _found(spark, path).select(F.regexp_extract("path", r"chunk_(\d+)\.bin$", 1).cast("bigint").alias("chunk_id"), "content")

    def run(batches):
        for batch in batches:
            numbers = batch.column("chunk_id").to_pylist()
            held, size = [], 0
            for number, content in zip(numbers, batch.column("content")):
                ids = np.frombuffer(content.as_buffer(), "<u2")
                for at in range(0, max(1, len(ids)), part):
                    held.append((number, at, ids[at : at + part].astype(np.int32)))
                    size += len(held[-1][2])
                    if size >= PART:
                        yield _batch(held)
                        held, size = [], 0
            if held:
                yield _batch(held)

    return raw.mapInArrow(run, "chunk_id bigint, offset bigint, tokens array<int>")


def _batch(held: list[tuple]):
    import numpy as np
    import pyarrow as pa

    edges = np.r_[0, np.cumsum([len(t) for _, _, t in held])].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([t for _, _, t in held])))
    return pa.RecordBatch.from_pydict({"chunk_id": pa.array([c for c, _, _ in held], pa.int64()), "offset": pa.array([at for _, at, _ in held], pa.int64()), "tokens": lists})


def write(parts: DataFrame, path: str, shard: int | None = None, part: int = PART) -> None:
    """Files of the parts (chunk_id, offset, tokens), which leave no gap in a chunk; a task takes whole chunks, a part at a time."""
    register(parts.sparkSession)
    n = F.size("tokens")
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / part).cast("int")), lambda k: F.struct((F.col("offset") + k * part).alias("offset"), F.slice("tokens", k * part + 1, F.lit(part)).alias("tokens"))))
    small = parts.filter(n > 0).select("chunk_id", cut.alias("p")).select("chunk_id", "p.*")
    writer = small.repartition("chunk_id").sortWithinPartitions("chunk_id", "offset").write.format("token_chunks").mode("append")
    (writer.option("shard", shard) if shard else writer).save(path)


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class ChunkWriter(DataSourceArrowWriter):
    """Each task writes its chunks beside their places; the commit moves them there, an abort takes them away.

    Parts of a chunk come one after the other, in order and without gaps, as write() deals them.
    """

    def __init__(self, path: str, per_shard: int | None):
        self.path, self.per_shard = path, per_shard

    def _place(self, chunk_id: int) -> str:
        folder = self.path if self.per_shard is None else os.path.join(self.path, f"shard_{chunk_id // self.per_shard:03d}")
        return os.path.join(folder, f"chunk_{chunk_id:04d}.bin")

    def write(self, iterator):
        import numpy as np
        from pyspark import TaskContext

        attempt, names, now, out, n = TaskContext.get().taskAttemptId(), [], None, None, 0
        try:
            for batch in iterator:
                for k, (chunk_id, offset) in enumerate(zip(batch.column("chunk_id").to_pylist(), batch.column("offset").to_pylist(), strict=True)):
                    if chunk_id != now:
                        if out is not None:
                            out.close()
                        place, now, n = self._place(chunk_id), chunk_id, 0
                        os.makedirs(os.path.dirname(place), exist_ok=True)
                        names.append((f"{place}.{attempt}", place))
                        out = open(f"{place}.{attempt}", "wb")
                    ids = batch.column("tokens")[k].values.to_numpy(zero_copy_only=False)
                    if offset != n:
                        raise ValueError(f"chunk {chunk_id} goes on at {offset} after {n} tokens")
                    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 16:
                        raise ValueError(f"chunk {chunk_id} holds ids beyond 16 bits")
                    out.write(np.asarray(ids).astype("<u2").tobytes())
                    n += len(ids)
        except BaseException:
            for given, _ in names:
                if os.path.exists(given):
                    os.remove(given)
            raise
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        for m in messages:
            for given, place in m.names if m else ():
                os.replace(given, place)

    def abort(self, messages):
        for m in messages:
            for given, _ in m.names if m else ():
                if os.path.exists(given):
                    os.remove(given)


class ChunkSource(DataSource):
    """What write() writes with: df.write.format("token_chunks").option("shard", 40).mode("append").save(path); a shared folder."""

    @classmethod
    def name(cls):
        return "token_chunks"

    def schema(self):
        return "chunk_id bigint, offset bigint, tokens array<int>"

    def writer(self, schema, overwrite):
        per = self.options.get("shard")
        return ChunkWriter(self.options["path"], int(per) if per else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkSource)
