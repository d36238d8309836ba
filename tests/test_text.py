"""Literal edges of cleaning and measures, and properties."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.functions import constants as K
from sievewright.functions import text as T


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


CASES = [
    (T.decode_entities, "&amp;lt;", "<"),
    (T.clean_markup, "a < b and c > d", "a d"),
    (T.clean_markup, "&lt;b&gt;x", "<b>x"),
    (T.clean_markup, ".a, .b { color: red; } end", "end"),
    (T.clean_markup, ".a .b { x } end", ".a end"),
    (T.clean_markup, "<SCRIPT>if (a) b</script>x <p class='y'>z</p>\n\n\n\nw", "x z \n\nw"),
    (T.clean_markup, 'style="x" kept', "kept"),
    (T.redact, "hub +6281234567890 ya", "hub +[TELEPON] ya"),
    (T.redact, "a@b.com. next", "[EMAIL]. next"),
    (T.redact, "0812345678901234", "0812345678901234"),
    (T.normalise, "  A\t\nB ", "a b"),
    (T.normalise, "\xa0　X\x1cY\x85", "x y"),
    (T.cap_repeats, "a a a a a b", "a a a b"),
    (T.cap_repeats, " \t", " \t"),
    (T.cap_repeats, "a", "a"),
    (T.has_symbol_run, "!!!!", False),
    (T.has_symbol_run, "!!!!!", True),
    (T.has_symbol_run, "_____", True),
    (T.has_symbol_run, "! ! ! ! !", False),
    (T.symbol_ratio, "", 1.0),
    (T.symbol_ratio, "²½☃☃", 0.75),
    (T.markup_density, "", 0.0),
    (T.markup_density, "<b>xx", 0.6),
    (lambda c: T.keyword_hits(c, K.MARKETING), "pendaftaran mendaftar", 4),
    (lambda c: T.keyword_hits(c, K.PROFANITY), "masuk", 1),
    (T.has_suspicious_domain, "www.livejournal.com", True),
    (T.has_suspicious_domain, "https://a.com/x.topic", True),
    (T.has_suspicious_domain, "a.xyz", False),
    (T.link_count, "http://a www.b HTTP://c https://d<e", 3),
    (T.boilerplate_density, "abc\rMenu: x", 0.0),
    (T.boilerplate_density, "abc\nMenu: x", 1000 / 3),
    (T.boilerplate_density, "All Rights Reserved", 1000 / 3),
    (T.boilerplate_density, "small rights reserved", 0.0),
    (T.no_punctuation, "a b", True),
    (T.no_punctuation, "a, b", False),
    (T.word_count, "", 0),
    (T.word_count, "\x1ca\x85b ", 2),
    (lambda c: T.language_vote(F.array(F.lit("en"), F.lit("fr"))), "", True),
    (lambda c: T.language_vote(F.array(F.lit("de"), F.lit("fr"))), "", False),
    (lambda c: T.language_vote(F.array().cast("array<string>")), "", True),
    (T.format_prompt, "hi", "<pengguna>hi</pengguna><asisten>"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_edges(spark, k):
    column, text, want = CASES[k]
    got = value(spark, text, column)
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_style_rules_need_no_stack(spark):
    assert value(spark, ",".join(["a"] * 20_000), T.strip_css) == ",".join(["a"] * 20_000)
    assert value(spark, "{" + ",".join(["a"] * 3000), T.strip_css).startswith("{a")


def test_dominant_share(spark):
    for text, want in [("x x x x a b c d e f", 0.4), ("x x x x x a b c d e", 0.5), ("", 0.0), ("y " * 9, 1.0)]:
        got = value(spark, text, T.dominant_share)
        assert got == pytest.approx(want) if want > 0.4 or not want else got <= 0.4


def test_language_samples(spark):
    assert value(spark, "a" * 799, T.language_samples) == []
    got = value(spark, "a" * 2100, T.language_samples)
    assert [len(s) for s in got] == [1785, 1050, 315]
    assert [len(s) for s in value(spark, "a" * 900, T.language_samples)] == [765, 450]


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_words_as_python_has_them(spark, texts):
    texts = [t.replace("\x00", "") for t in texts if not re.search("[\ud800-\udfff]", t)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = rows.select("i", T.words("t").alias("w"), T.word_count("t").alias("n"), T.normalise("t").alias("x"), T.normalise(T.normalise("t")).alias("y"))
    for r in rows.collect():
        assert r.w == texts[r.i].split() and r.n == len(r.w)
        assert r.x == r.y
