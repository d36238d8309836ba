"""Decode-time operators over (step, token_id, logit) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(logits: DataFrame, temperature: float) -> DataFrame:
    return logits.withColumn("logit", F.col("logit") / temperature)


def penalised(logits: DataFrame, history: DataFrame, penalty: float) -> DataFrame:
    """penalty to the power of a token's count in its step's history: positive logits are divided, others multiplied.

    history: step, token_id, a row for each token generated before.
    """
    counts = history.groupBy("step", "token_id").agg(F.count("*").alias("__n"))
    strength = F.pow(F.lit(float(penalty)), F.coalesce("__n", F.lit(0)))
    joined = logits.join(counts, ["step", "token_id"], "left")
    return joined.withColumn("logit", F.when(F.col("logit") > 0, F.col("logit") / strength).otherwise(F.col("logit") * strength)).drop("__n")


def banned_tokens(sequences: DataFrame, n: int) -> DataFrame:
    """(step, token_id): tokens that would complete a run of n that the step's tokens array holds already."""
    t = F.col("tokens")
    size = F.size(t)
    tail = F.slice(t, F.greatest(size - n + 2, F.lit(1)), n - 1) if n > 1 else F.array().cast("array<int>")
    places = F.when(size >= n, F.filter(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.slice(t, i, n - 1) == tail if n > 1 else F.lit(True))).otherwise(F.array().cast("array<int>"))
    return sequences.select("step", F.explode(F.array_distinct(F.transform(places, lambda i: F.get(t, i + n - 2)))).alias("token_id"))


def without_banned(logits: DataFrame, banned: DataFrame) -> DataFrame:
    return logits.join(banned, ["step", "token_id"], "left_anti")


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """The k largest logits of each step; ties with the kth stay."""
    return logits.withColumn("__r", F.rank().over(Window.partitionBy("step").orderBy(F.desc("logit")))).filter(F.col("__r") <= k).drop("__r")


def probabilities(logits: DataFrame) -> DataFrame:
    every = Window.partitionBy("step")
    grown = logits.withColumn("__e", F.exp(F.col("logit") - F.max("logit").over(every)))
    return grown.withColumn("probability", F.col("__e") / F.sum("__e").over(every)).drop("__e")


def draw_at(chances: DataFrame, point: Column) -> DataFrame:
    """(step, token_id): of each step the first token whose running probability exceeds the point, of 0 to 1."""
    order = Window.partitionBy("step").orderBy("token_id")
    reached = chances.withColumns({"__upto": F.sum("probability").over(order), "__u": point})
    return reached.groupBy("step").agg(F.coalesce(F.min(F.when(F.col("__upto") > F.col("__u"), F.col("token_id"))), F.max("token_id")).alias("token_id"))


def draw(chances: DataFrame, seed: int) -> DataFrame:
    """(step, token_id): one draw a step from its probabilities, the same for the same seed."""
    return draw_at(chances, F.pmod(F.xxhash64(F.lit(seed), "step"), F.lit(1 << 53)) / float(1 << 53))
