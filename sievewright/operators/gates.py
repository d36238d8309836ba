"""The cascade: measures of each document, the first gate that rejects it, and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import constants as K
from sievewright.functions import text as T
from sievewright.functions.constants import Thresholds

#: The column of what a detector says of a text's samples.
VOTES = "language_votes"


def arrived(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stripped texts; null and blank ones go, without a reason."""
    return docs.withColumn(text, T.strip(text)).filter(F.length(text) > 0)


def with_measures(docs: DataFrame, text: str = "text", limits: Thresholds = Thresholds()) -> DataFrame:
    """markup_density of the raw text; clean_text; and the measures of that. They replace input columns of their names.

    Four projections: each column that others read several times is computed once in the projection below.
    """
    clean = docs.withColumns({"markup_density": T.markup_density(text), "clean_text": T.clean_markup(text)})
    lowered = clean.withColumns({"__low": F.lower("clean_text"), "__rest": T.unusual("clean_text")})
    split = lowered.withColumn("__words", T.words("__low"))  # as many as clean_text has
    counted = split.withColumn("n_words", F.size("__words"))
    n = F.col("n_words")
    return counted.withColumns(
        {
            "symbol_ratio": T.symbol_ratio("clean_text", "__rest"),
            "symbol_run": T.has_symbol_run("clean_text", limits.symbol_run, "__rest"),
            "boilerplate": T.boilerplate_density("clean_text", n, "__low"),
            "gambling": T.has_any("__low", K.GAMBLING_ADULT),
            "suspicious": T.has_suspicious_domain("__low"),
            "links": T.link_count("clean_text"),
            "dominant": T.dominant_share("__low", "__words"),
            "unpunctuated": T.no_punctuation("clean_text"),
            "profanity": T.keyword_density("__low", K.PROFANITY, n),
            "marketing": T.keyword_density("__low", K.MARKETING, n),
            "educational": T.keyword_density("__low", K.EDUCATIONAL, n),
        }
    ).drop("__low", "__rest", "__words")


def reason(limits: Thresholds = Thresholds()) -> Column:
    """The first gate that rejects a row with measures, null if none does; duplicates come later."""
    c = F.col
    gates = [
        ("html_css_spam", c("markup_density") > limits.max_markup_density),
        ("panjang_invalid", ~c("n_words").between(limits.min_words, limits.max_words)),
        ("symbol_spam", (c("symbol_ratio") > limits.max_symbol_ratio) | c("symbol_run")),
        ("boilerplate", c("boilerplate") > limits.max_boilerplate),
        ("gambling_adult_content", c("gambling")),
        ("suspicious_domain", c("suspicious")),
        ("excessive_links", c("links") > limits.max_links),
        ("dominant_repeated_word", (c("n_words") >= limits.dominant_min_words) & (c("dominant") > 0.4)),
        ("no_punctuation", c("unpunctuated")),
        ("profanity", c("profanity") > limits.max_profanity),
        ("marketing_spam", c("marketing") > limits.max_marketing),
    ]
    if limits.language == "column":
        gates.append(("bahasa_tidak_diizinkan", ~T.language_vote(F.array(limits.language_column))))
    elif limits.language != "off":
        gates.append(("bahasa_tidak_diizinkan", ~T.language_vote(VOTES if limits.language == "detect" else limits.language)))
    chain = F
    for name, rejects in gates:
        chain = chain.when(rejects, F.lit(name))
    return chain.otherwise(F.lit(None).cast("string"))


def with_votes(docs: DataFrame, detect: Callable[[list[str]], list[str | None]], text: str = "clean_text", votes: str = VOTES) -> DataFrame:
    """Adds votes, array<string>: what detect says of each sample of the text, in Arrow batches; None is no vote.

    detect runs in Python workers, on the samples of many rows at once.
    """
    names = [c for c in docs.columns if c != votes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = batch.column("__samples")
            said = pa.array(list(detect(samples.flatten().to_pylist())), pa.string())
            edges = pa.array(np.r_[0, np.cumsum(pc.list_value_length(samples).to_numpy(zero_copy_only=False))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.ListArray.from_arrays(edges, said)], names=[*names, votes])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != votes), f"`{votes}` array<string>"])
    return docs.select(*names, T.language_samples(text).alias("__samples")).mapInArrow(run, schema)


def with_reason(docs: DataFrame, text: str = "text", limits: Thresholds = Thresholds(), detect: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """Adds the measures and reason; columns of their names are replaced. detect names the languages of samples for limits.language == "detect".

    reason comes out of a generator of one row: a filter on it would otherwise be pushed below the projections, with
    every measure written out in it once for each use.
    """
    if (limits.language == "detect") != (detect is not None):
        raise ValueError('a detector and limits.language = "detect" go together')
    measured = with_measures(docs.drop("reason"), text, limits)
    if detect is not None:
        measured = with_votes(measured, detect)
    return measured.select("*", F.explode(F.array(reason(limits))).alias("reason"))


def measure() -> Column:
    """The number that a row's reason goes by, null where it goes by none; rows with measures and reason."""
    by = {"html_css_spam": "markup_density", "panjang_invalid": "n_words", "symbol_spam": "symbol_ratio", "boilerplate": "boilerplate", "profanity": "profanity", "marketing_spam": "marketing"}
    chain = F
    for name, column in by.items():
        chain = chain.when(F.col("reason") == name, F.col(column).cast("double"))
    return chain.otherwise(F.lit(None).cast("double"))


def histogram(judged: DataFrame, top: int | None = None) -> DataFrame:
    """Rejects by reason, most first."""
    counts = judged.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), "reason")
    return ordered if top is None else ordered.limit(top)


def funnel(seen: DataFrame, judged: DataFrame) -> DataFrame:
    """How many rows were seen, kept and rejected, and the share kept in percent."""
    none = F.lit(0).cast("bigint")
    a = seen.agg(F.count("*").alias("seen"), none.alias("kept"), none.alias("rejected"))
    b = judged.agg(none.alias("seen"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count("reason").alias("rejected"))
    both = a.union(b).agg(F.sum("seen").alias("seen"), F.sum("kept").alias("kept"), F.sum("rejected").alias("rejected"))
    return both.withColumn("kept_percent", F.when(F.col("seen") == 0, 0.0).otherwise(F.col("kept") / F.col("seen") * 100))
