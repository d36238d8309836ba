"""Token chunks: cutting, splits, shards and training windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import constants as K


def chunk_parts(docs: DataFrame, size: int = K.CHUNK_TOKENS, source: str = "source_rank", before: str = "before", tokens: str = "tokens", keep: list[str] = [], count: str | None = None) -> DataFrame:
    """(chunk_id, offset, tokens, and columns to keep): what each document gives to each chunk.

    A source's tokens stand one after the other and are cut every size tokens; the cut starts anew with each source
    and chunk numbers go on. docs: source rank, tokens before the document in its source, tokens array. count: a column
    of the tokens' number, if it is there; totals and the filter then don't make the tokens once more.
    """
    own = F.size(tokens) if count is None else F.col(count)
    totals = docs.groupBy(source).agg(F.max(F.col(before) + own).alias("n"))
    firsts = totals.select(F.col(source).alias("__s"), F.coalesce(F.sum(F.ceil(F.col("n") / size)).over(Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    held = docs.filter(own > 0).join(firsts, F.col(source) == F.col("__s"))
    start, n = F.col(before), F.size(tokens)
    spread = held.select(*keep, "__first", start.alias("start"), F.col(tokens).alias("t"), F.explode(F.sequence(F.floor(start / size), F.floor((start + n - 1) / size))).alias("k"))
    low = F.greatest(F.col("k") * size - F.col("start"), F.lit(0)).cast("int")
    high = F.least((F.col("k") + 1) * size - F.col("start"), F.size("t")).cast("int")
    return spread.select(*keep, (F.col("__first") + F.col("k")).cast("bigint").alias("chunk_id"), (F.col("start") + low - F.col("k") * size).cast("bigint").alias("offset"), F.slice("t", low + 1, high - low).alias("tokens"))


def chunk_sizes(parts: DataFrame) -> DataFrame:
    """chunk_id, n_tokens of each chunk."""
    return parts.groupBy("chunk_id").agg(F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"))


def shard(chunk_id="chunk_id", per: int = K.SHARD_CHUNKS) -> Column:
    return F.floor(F.col(chunk_id) / per).cast("bigint")


def chunk_name(chunk_id="chunk_id", per: int = K.SHARD_CHUNKS) -> Column:
    """Numbers of more digits than the name has room for stay whole, as in the files' names; lpad would cut them."""
    return F.format_string("shard_%03d/chunk_%04d.bin", shard(chunk_id, per), F.col(chunk_id))


def split_validation(chunks: DataFrame, last: int = 2, by: str = "chunk_id") -> DataFrame:
    """Adds validation: whether a chunk is among the last by name or number; 0 means that none is."""
    ids = chunks.select(F.col(by).alias("__id")).distinct().orderBy(F.desc("__id")).limit(last)
    marked = chunks.join(F.broadcast(ids), F.col(by) == F.col("__id"), "left")
    return marked.withColumn("validation", F.col("__id").isNotNull()).drop("__id")


def windows(parts: DataFrame, draws: DataFrame, length: int) -> DataFrame:
    """(draw, chunk_id, start, x, y) for draws (draw, chunk_id, start): y is x one token later.

    parts: chunk_id, offset, tokens, as chunks are held. They are cut into cells of length + 1 tokens, so a window lies
    in two cells, which it meets by an equi-join; no chunk is put together.
    """
    w, o, n = length + 1, F.col("offset"), F.size("tokens")
    spread = parts.filter(n > 0).select("chunk_id", "offset", "tokens", F.explode(F.sequence(F.floor(o / w), F.floor((o + n - 1) / w))).alias("cell"))
    low = F.greatest(F.col("cell") * w - o, F.lit(0)).cast("int")
    high = F.least((F.col("cell") + 1) * w - o, n).cast("int")
    cells = spread.select("chunk_id", "cell", (o + low).alias("at"), F.slice("tokens", low + 1, high - low).alias("some"))
    first = F.floor(F.col("start") / w)
    asked = draws.select("draw", "chunk_id", "start", F.explode(F.array(first, first + 1)).alias("cell"))
    met = asked.join(cells, ["chunk_id", "cell"]).groupBy("draw", "chunk_id", "start").agg(F.array_sort(F.collect_list(F.struct("at", "some"))).alias("p"))
    joined = met.select("draw", "chunk_id", "start", (F.col("start") - F.col("p")[0]["at"]).cast("int").alias("skip"), F.flatten(F.transform("p", lambda p: p["some"])).alias("t"))
    return joined.select("draw", "chunk_id", "start", F.slice("t", F.col("skip") + 1, F.lit(length)).alias("x"), F.slice("t", F.col("skip") + 2, F.lit(length)).alias("y"))


def draw_windows(sizes: DataFrame, n: int, length: int, seed: int, by_size: bool = False) -> DataFrame:
    """n draws with replacement: a uniform chunk (by_size: as likely as it has starts), then a uniform start.

    sizes: chunk_id, n_tokens; a row a chunk. Chunks of at most length + 1 tokens are never drawn. Chunks stand on a
    line of their weights and a draw falls on one; the join is by range, cut into equal steps of the line.
    """
    able = sizes.filter(F.col("n_tokens") > length + 1).withColumn("w", (F.col("n_tokens") - length - 1) if by_size else F.lit(1).cast("bigint"))
    order = Window.orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    lined = able.withColumn("at", F.coalesce(F.sum("w").over(order), F.lit(0)))
    total, step = able.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.max("w"), F.lit(1))).first()
    if not total:
        return sizes.sparkSession.createDataFrame([], "draw bigint, chunk_id bigint, start bigint")
    draws = sizes.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(F.rand(seed) * total).alias("point"), F.rand(seed + 1).alias("u"))
    cells = lined.select("chunk_id", "n_tokens", "at", "w", F.explode(F.sequence(F.floor(F.col("at") / step), F.floor((F.col("at") + F.col("w") - 1) / step))).alias("cell"))
    joined = draws.withColumn("cell", F.floor(F.col("point") / step)).join(cells, "cell").filter("point >= at AND point < at + w")
    return joined.select("draw", "chunk_id", F.floor(F.col("u") * (F.col("n_tokens") - length - 1)).cast("bigint").alias("start"))
