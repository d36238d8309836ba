"""The whole build: sources in order, each cleaned, judged, deduplicated, selected, encoded, packed and committed.

Sources take turns because documents beyond a source's budget are never seen and must not suppress later ones. Within
a source everything is one plan. State and chunks of a source are written before its progress, so a run that breaks
off is repeated from the last whole source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import constants as K
from sievewright.functions import text as T
from sievewright.functions.constants import Thresholds
from sievewright.functions.frames import cut
from sievewright.operators import dedup, gates, pack, select, tokens
from sievewright.sources import chunks, state

EXACT, SIGNATURES = "exact_hash string", "id bigint, signature array<string>"


@dataclass(frozen=True)
class Settings:
    limits: Thresholds = Thresholds()
    buffer: int = K.BUFFER_DOCS
    chunk: int = K.CHUNK_TOKENS
    shard: int | None = K.SHARD_CHUNKS
    redact: bool = False
    eos: int | None = None
    total: int | None = None
    #: Minimum hashes by XXH64 in place of MD5; all of a build's state must agree.
    fast: bool = False
    #: Languages of text samples, for limits.language == "detect".
    detect: Callable[[list[str]], list[str | None]] | None = None


def new_documents(passed: DataFrame, exact: DataFrame, signatures: DataFrame, text: str = "clean_text", seq: str = "seq", fast: bool = False) -> DataFrame:
    """Adds dup_reason, given hashes and kept signatures of earlier sources; passed rows have distinct seq.

    A row whose hash is known, or seen in an earlier row, is an exact duplicate. A row near a stored signature, or near
    an earlier row that stays, is a near duplicate. signature and exact_hash stay as columns.
    """
    base = signatures.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0] + 1
    judged = dedup.exact_duplicates(passed, text, [seq])
    known = exact.select(F.col("exact_hash").alias("__h")).distinct().withColumn("__known", F.lit(True))
    judged = cut(judged.join(known, F.col("exact_hash") == F.col("__h"), "left").withColumn("duplicate", F.col("duplicate") | F.col("__known").isNotNull()).drop("__h", "__known"))
    texts = judged.filter(~F.col("duplicate")).select((F.col(seq) + base).alias("id"), F.col(text).alias("text"))
    fresh = cut(dedup.signed(texts, "text", fast).withColumn("slots", dedup.slots("signature")))
    firsts = cut(fresh.groupBy("slots").agg(F.min("id").alias("id")))
    stored = cut(dedup.near_to(signatures.select("id", dedup.slots("signature").alias("slots")), firsts))
    gone = stored.union(dedup.overtaken(firsts.join(stored, "id", "left_anti"))).select(F.col("id").alias("first"), F.lit(True).alias("__lost"))
    near = fresh.join(firsts.withColumnRenamed("id", "first"), "slots").join(gone, "first", "left")
    near = near.select(F.col("id").alias("__id"), "signature", (F.coalesce("__lost", F.lit(False)) | (F.col("id") != F.col("first"))).alias("__near"))
    out = judged.join(near, judged[seq] + base == near["__id"], "left")
    why = F.when(F.col("duplicate"), "exact_duplicate").when(F.coalesce("__near", F.lit(False)), "near_duplicate")
    return out.withColumn("dup_reason", why).withColumn("id", F.col(seq) + base).drop("duplicate", "__near", "__id")


@dataclass
class Selected:
    judged: DataFrame
    emitted: DataFrame
    exact: DataFrame
    signatures: DataFrame


def select_source(docs: DataFrame, exact: DataFrame, signatures: DataFrame, target: int, count: Callable[[DataFrame], DataFrame], settings: Settings = Settings()) -> Selected:
    """One source's rows (seq, text) to what it emits and adds to the state; count adds tokens (array) and n_tokens."""
    judged = cut(gates.with_reason(gates.arrived(docs), "text", settings.limits, settings.detect))
    passed = judged.filter(F.col("reason").isNull())
    if settings.redact:
        passed = passed.withColumn("clean_text", T.redact("clean_text"))
    marked = cut(new_documents(passed, exact, signatures, fast=settings.fast))
    kept = cut(count(marked.filter(F.col("dup_reason").isNull()).withColumn("__all", F.lit(0))))
    ordered = cut(select.emitted(kept, "educational", "n_tokens", settings.buffer, "__all"))
    emitted = select.within_budget(ordered, F.lit(target))
    # The row that filled the buffer in which the target was crossed is the last one seen.
    crossing = ordered.filter(F.col("before") + F.col("n_tokens") >= target).agg(F.min("buffer")).first()[0]
    last = None if crossing is None else ordered.filter(F.col("buffer") == crossing).agg(F.max("seq")).first()[0]
    seen = marked if last is None else marked.filter(F.col("seq") <= last)
    reasons = judged.join(marked.select(F.col("seq").alias("__s"), "dup_reason"), F.col("seq") == F.col("__s"), "left").withColumn("reason", F.coalesce("reason", "dup_reason")).drop("__s", "dup_reason")
    return Selected(
        reasons if last is None else reasons.filter(F.col("seq") <= last),
        emitted,
        seen.select("exact_hash").distinct(),
        seen.filter(F.col("dup_reason").isNull()).select("id", "signature"),
    )


def build(spark: SparkSession, sources: dict[str, DataFrame], targets: dict[str, int], model: bytes, out: str, settings: Settings = Settings()) -> state.Progress:
    """Every source that isn't complete; chunks, state tables and progress.json go to the folder out.

    A source that fails is listed as failed, not as complete, and the build goes on.
    """
    progress = state.load_progress(spark, f"{out}/progress.json")

    def count(rows: DataFrame) -> DataFrame:
        return tokens.encode(rows, model, "clean_text", settings.eos).withColumn("n_tokens", F.size("tokens").cast("bigint"))

    for rank, (name, docs) in enumerate(sources.items()):
        if name in progress.completed_sources:
            continue
        if settings.total is not None and progress.total_tokens >= settings.total:
            break
        target = max(0, targets[name] - progress.tokens_per_source.get(name, 0))
        if target:
            exact = state.read_if_there(spark, [f"{out}/state/exact/{b}" for b in progress.batches], EXACT)
            signatures = state.read_if_there(spark, [f"{out}/state/signatures/{b}" for b in progress.batches], SIGNATURES)
            try:
                got = select_source(docs, exact, signatures, target, count, settings)
                rows = cut(got.emitted.withColumn("source_rank", F.lit(rank)))
                parts = pack.chunk_parts(rows, settings.chunk).withColumn("chunk_id", F.col("chunk_id") + progress.chunk_idx)
                chunks.write(parts, out, settings.shard)
                batch = f"{rank:03d}"
                got.exact.write.mode("overwrite").parquet(f"{out}/state/exact/{batch}")
                got.signatures.write.mode("overwrite").parquet(f"{out}/state/signatures/{batch}")
            except Exception as failure:  # noqa: BLE001  the build goes on with other sources, and says so
                progress.failed_sources = sorted({*progress.failed_sources, name})
                state.save_progress(spark, f"{out}/progress.json", progress)
                print(f"{name}: {failure}")
                continue
            n = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
            progress.chunk_idx += -(-n // settings.chunk)
            progress.total_tokens += n
            progress.tokens_per_source[name] = progress.tokens_per_source.get(name, 0) + n
            progress.batches.append(batch)
        progress.failed_sources = [s for s in progress.failed_sources if s != name]
        progress.completed_sources.append(name)
        state.save_progress(spark, f"{out}/progress.json", progress)
    return progress
