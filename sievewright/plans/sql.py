"""SQL fragments that state the same definitions as functions.text, for an engine whose patterns have no look-around."""

from __future__ import annotations

import string

from sievewright.functions import constants as K
from sievewright.functions import text as T

WS = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
W = r"\p{L}\p{N}_"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def count(t: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, {quoted(pattern)})) AS INTEGER)"


def replaced(t: str, pattern: str, by: str) -> str:
    return f"regexp_replace({t}, {quoted(pattern)}, {quoted(by)}, 'g')"


def strip(t: str) -> str:
    return replaced(t, f"^[{WS}]+|[{WS}]+$", "")


def words(t: str) -> str:
    return f"regexp_extract_all({t}, {quoted(f'[^{WS}]+')})"


def word_count(t: str) -> str:
    return count(t, f"[^{WS}]+")


def normalise(t: str) -> str:
    return strip(replaced(f"lower({t})", f"[{WS}]+", " "))


def hits(t: str, keywords: list[str]) -> str:
    return "(" + " + ".join(f"(length({t}) - length(replace({t}, {quoted(k)}, ''))) // {len(k)}" for k in keywords) + ")"


def density(hits_: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE CAST({hits_} AS DOUBLE) / {n} * 1000 END"


TAG = "<[^>]+>"
CSS = rf"[.#]?[{W}-]+(?:[{WS}]*[,>+~][{WS}]*[.#]?[{W}-]+)*[{WS}]*\{{[^{{}}]*\}}"


def strip_blocks(t: str) -> str:
    for tag in K.BLOCK_TAGS:
        t = replaced(t, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return t


def decode_entities(t: str) -> str:
    for name, char in K.ENTITIES:
        t = f"replace({t}, {quoted(name)}, {quoted(char)})"
    return t


def clean(t: str) -> str:
    t = replaced(decode_entities(replaced(strip_blocks(t), TAG, " ")), CSS, " ")
    return tidy(strip_attributes(t))


def strip_attributes(t: str) -> str:
    return replaced(t, rf"""(?i)(^|[^{W}])(?:style|class)[{WS}]*=[{WS}]*["'][^"']*["']""", r"\1 ")


def tidy(t: str) -> str:
    return strip(replaced(replaced(t, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def lengths(t: str, pattern: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({t}, {quoted(pattern)}), lambda m: length(m))), 0)"


def markup_density(t: str) -> str:
    return f"CASE WHEN length({t}) = 0 THEN 0.0 ELSE CAST({lengths(t, TAG)} + {lengths(t, CSS)} AS DOUBLE) / length({t}) END"


def symbol_ratio(t: str) -> str:
    odd = count(t, rf"[^\p{{L}}\p{{Nd}}{T.DIGITS}{WS}{T.in_class(K.ALLOWED_SYMBOLS)}]")
    return f"CASE WHEN length({t}) = 0 THEN 1.0 ELSE CAST({odd} AS DOUBLE) / length({t}) END"


def symbol_run(t: str, least: int = 5) -> str:
    return "(" + " OR ".join(f"contains({t}, {quoted(c * least)})" for c in string.punctuation + "°µ±÷×…—–“”‘’•·©®™§¶«»¿¡") + ")"


def boilerplate_hits(t: str) -> str:
    plain = [T.spelled_out(p, WS, f"(?:^|[^{W}])", f"(?:$|[^{W}])") for p in K.BOILERPLATE]
    return "(" + " + ".join(count(t, ("(?im)" if p.startswith("^") else "(?i)") + p) for p in plain) + ")"


def any_of(t: str, keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {quoted(k)})" for k in keywords) + ")"


URL = rf"""https?://[^{WS}<>"]+|www\.[^{WS}<>"]+"""


def suspicious(t: str) -> str:
    return f"(len(list_filter(regexp_extract_all({t}, {quoted(URL)}), lambda u: {any_of('u', K.SUSPICIOUS_DOMAINS)})) > 0)"


def measured(table: str, key: str, text: str, extra: str = "") -> str:
    """CTEs that end in judged: key, clean_text, the measures, for texts that aren't blank."""
    return f"""arrived AS (
  SELECT {key}, {extra} {strip(text)} AS text FROM {table} WHERE length({strip(text)}) > 0
), cleaned AS (
  SELECT *, {markup_density('text')} AS markup_density, {clean('text')} AS clean_text FROM arrived
), lowered AS (
  SELECT *, lower(clean_text) AS low, {word_count('clean_text')} AS n_words FROM cleaned
), frequent AS (
  SELECT {key}, max(n) AS maximum FROM (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest({words('low')}) AS w FROM lowered) GROUP BY ALL) GROUP BY ALL
), judged AS (
  SELECT l.*, {symbol_ratio('clean_text')} AS symbol_ratio, {symbol_run('clean_text')} AS symbol_run,
    {density(boilerplate_hits('clean_text'), 'n_words')} AS boilerplate, {any_of('low', K.GAMBLING_ADULT)} AS gambling,
    {suspicious('low')} AS suspicious, {count('clean_text', URL)} AS links,
    CASE WHEN n_words = 0 THEN 0.0 ELSE CAST(maximum AS DOUBLE) / n_words END AS dominant,
    NOT regexp_matches(clean_text, '[.,?!]') AS unpunctuated, {density(hits('low', K.PROFANITY), 'n_words')} AS profanity,
    {density(hits('low', K.MARKETING), 'n_words')} AS marketing, {density(hits('low', K.EDUCATIONAL), 'n_words')} AS educational
  FROM lowered l LEFT JOIN frequent f ON f.{key} = l.{key}
)"""


def reason(least: int = 500, most: int = 10_000, language: bool = False) -> str:
    voted = f"WHEN lang NOT IN ({', '.join(map(quoted, K.ALLOWED_LANGUAGES))}) THEN 'bahasa_tidak_diizinkan'" if language else ""
    return f"""CASE WHEN markup_density > 0.15 THEN 'html_css_spam' WHEN n_words < {least} OR n_words > {most} THEN 'panjang_invalid'
  WHEN symbol_ratio > 0.30 OR symbol_run THEN 'symbol_spam' WHEN boilerplate > 3.0 THEN 'boilerplate' WHEN gambling THEN 'gambling_adult_content'
  WHEN suspicious THEN 'suspicious_domain' WHEN links > 10 THEN 'excessive_links' WHEN n_words >= 10 AND dominant > 0.4 THEN 'dominant_repeated_word'
  WHEN unpunctuated THEN 'no_punctuation' WHEN profanity > 3.0 THEN 'profanity' WHEN marketing > 15.0 THEN 'marketing_spam' {voted} END"""
