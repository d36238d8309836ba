"""Order and budgets: buffers sorted by score, cumulative token targets, corpus caps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import constants as K
from sievewright.functions.frames import running_sum


def ranges(column: str, width: int = 4096) -> Column:
    """Bucket of a number along its order."""
    return F.floor(F.col(column) / width)


def buffered(docs: DataFrame, size: int = K.BUFFER_DOCS, source: str = "source", seq: str = "seq") -> DataFrame:
    """Adds position (from 0, within the source by seq) and buffer (every size rows)."""
    placed = running_sum(docs, "position", F.lit(1), [source], ranges(seq), [seq])
    return placed.withColumn("buffer", F.floor(F.col("position") / size).cast("bigint"))


def emitted(docs: DataFrame, score: str, tokens: str, size: int = K.BUFFER_DOCS, source: str = "source", seq: str = "seq") -> DataFrame:
    """Adds buffer and before: tokens of the source's rows before each, a buffer after the other, by score inside one.

    The rows are read several times: cut them first where they are dear.
    """
    return running_sum(buffered(docs, size, source, seq), "before", F.col(tokens), [source], F.col("buffer"), [F.desc(score), seq])


def within_budget(docs: DataFrame, target: Column, before: str = "before") -> DataFrame:
    """Rows that come before the target is reached; the one that crosses it is in."""
    return docs.filter(F.col(before) < target)


def remaining(catalog: DataFrame, done: DataFrame) -> DataFrame:
    """source, target, remaining, complete for each source of the catalog, given tokens that are there already."""
    left = catalog.join(done.withColumnRenamed("tokens", "__done"), "source", "left")
    rest = F.greatest(F.lit(0), F.col("target") - F.coalesce("__done", F.lit(0)))
    return left.select("source", "target", rest.cast("bigint").alias("remaining"), (rest <= 0).alias("complete"))


def turns(sums: DataFrame, stop: Callable[[Column], Column]) -> DataFrame:
    """Sources (source_rank, n_tokens; a row each) that have their turn before stop(total) tokens are there; adds before."""
    order = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumns({"before": F.coalesce(F.sum("n_tokens").over(order), F.lit(0)), "__total": F.sum("n_tokens").over(Window.partitionBy())})
    return placed.filter(F.col("before") < stop(F.col("__total"))).drop("__total")


def capped_corpus(docs: DataFrame, caps: list[tuple], total: int, source: str = "source_rank", seq: str = "seq", text: str = "text") -> DataFrame:
    """Rows of each ranked source (from 0) until its row cap or the running share of all characters is reached.

    Characters count over all sources so far; the row that reaches a limit is in, so each source gives one at least.
    Sources are few and their totals are carried from one to the next.
    """
    parts, carried = [], 0
    for rank, (rows, least, keep, share) in enumerate(caps):
        own = docs.filter((F.col(source) == rank) & (F.length(text) >= least))
        own = own.withColumn("piece", F.col(text) if keep is None else F.substring(text, 1, keep))
        own = running_sum(own, "chars_before", F.length("piece"), [source], ranges(seq), [seq])
        own = running_sum(own, "rows_before", F.lit(1), [source], ranges(seq), [seq])
        full = (F.col("rows_before") > 0) & ((F.col("rows_before") >= rows) | (F.col("chars_before") + carried >= total * share))
        own = own.filter(~full)
        carried += own.agg(F.sum(F.length("piece"))).first()[0] or 0
        parts.append(own)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
