"""Columns over texts: words, cleaning and measures. Built-in functions only.

White space is one explicit class, because no engine's own class is the same as another's; see WS.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions import constants as K

#: Inside a character class.
WS = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
LETTERS = r"\p{L}\p{N}"
#: Digits that aren't decimal numbers, such as superscripts.
DIGITS = "".join(chr(c) for c in range(0x20000) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_class(chars: Iterable[str]) -> str:
    """Characters as they stand in a Java character class."""
    return "".join("\\" + c if c in "\\[]^-&" else c for c in chars)


# -- words ------------------------------------------------------------------------------------------------------------


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(WS_CHARS))


def has_rare_space(c) -> Column:
    """Whether a text may hold white space but blanks, tabs and ends of lines: by bytes that all of that begins with."""
    t = col(c)
    raw = t.cast("binary")
    beyond = reduce(Column.__or__, [F.contains(raw, F.lit(bytes.fromhex(h))) for h in ("c285", "c2a0", "e19a80", "e280", "e2819f", "e38080")])
    return has_any(t, list("\x0b\x0c\x1c\x1d\x1e\x1f")) | ((F.octet_length(t) != F.length(t)) & beyond)


def blanks(c) -> Column:
    """Each character of white space as a blank; a pattern of the whole class only where one is called for."""
    usual = reduce(lambda t, x: F.replace(t, F.lit(x), F.lit(" ")), "\n\t\r", col(c))
    return let(usual, lambda t: F.when(has_rare_space(t), F.regexp_replace(t, f"[{WS}]", " ")).otherwise(t))


def words(c) -> Column:
    """By blanks, which need no pattern: one of the class takes several times as long."""
    return F.array_remove(F.split(blanks(c), " "), "")


def word_count(c) -> Column:
    return F.size(words(c))


def normalise(c) -> Column:
    """Lower case, white space to single blanks, none around."""
    return F.btrim(let(blanks(F.lower(col(c))), lambda t: where(t, ["  "], lambda x: F.regexp_replace(x, " +", " "))))


def prefix(c, n: int) -> Column:
    return F.substring(col(c), 1, n)


def cap_repeats(c, most: int = 3) -> Column:
    """Runs of one word cut to so many; words with one blank between; a text of white space stays."""

    def kept(own: Column) -> Column:
        again = lambda w, i: reduce(Column.__and__, [F.get(own, i - k) == w for k in range(1, most + 1)])
        return F.when(F.size(own) == 0, col(c)).otherwise(F.array_join(F.filter(own, lambda w, i: (i < most) | ~again(w, i)), " "))

    return let(words(c), kept)


# -- cleaning ---------------------------------------------------------------------------------------------------------

TAG = r"<[^>]+>"
#: A selector list with its braces. It is possessive and starts where a name starts, so it needs no stack and no retries.
_NAME = rf"[{LETTERS}_-]"
CSS = rf"(?:[.#]|(?<!{_NAME})){_NAME}++(?:[{WS}]*+[,>+~][{WS}]*+[.#]?{_NAME}++)*+[{WS}]*+\{{[^{{}}]*+\}}"
ATTRIBUTE = rf"""(?iu)(?<![{LETTERS}_])(?:style|class)[{WS}]*=[{WS}]*["'][^"']*["']"""


def where(c, parts: list[str], change) -> Column:
    """change(text) where the text holds one of the parts, without which nothing would change."""
    t = col(c)
    return F.when(has_any(t, parts), change(t)).otherwise(t)


def strip_blocks(c) -> Column:
    return F.regexp_replace(col(c), rf"(?isu)<({'|'.join(K.BLOCK_TAGS)})[^>]*>.*?</\1>", " ")


def strip_tags(c) -> Column:
    return F.regexp_replace(col(c), TAG, " ")


def decode_entities(c) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), K.ENTITIES, col(c))


def strip_css(c) -> Column:
    return where(c, ["{"], lambda t: F.regexp_replace(t, CSS, " "))  # no brace, no rule


def strip_attributes(c) -> Column:
    return F.regexp_replace(col(c), ATTRIBUTE, " ")


def tidy(c) -> Column:
    single = let(col(c), lambda t: where(t, ["  ", "\t"], lambda x: F.regexp_replace(x, r"[ \t]{2,}|\t", " ")))
    return strip(let(single, lambda t: where(t, ["\n\n\n"], lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n"))))


def clean_markup(c) -> Column:
    """Blocks, tags, entities, style rules, attributes, then white space; tags that entities spell survive."""
    t = where(c, ["<"], lambda t: strip_tags(strip_blocks(t)))
    t = let(t, lambda x: where(x, ["&"], decode_entities))
    t = let(t, strip_css)
    return tidy(let(t, lambda x: where(x, ["="], strip_attributes)))


def redact(c) -> Column:
    """E-mail addresses and Indonesian mobile numbers."""
    mail = where(c, ["@"], lambda t: F.regexp_replace(t, r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL]"))
    return F.regexp_replace(mail, r"(?U)\b(?:\+62|62|0)8[1-9][0-9]{6,10}\b", "[TELEPON]")


# -- measures ---------------------------------------------------------------------------------------------------------


def total_length(c, pattern: str) -> Column:
    return F.aggregate(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0)), F.lit(0), lambda n, m: n + F.length(m))


def markup_density(c) -> Column:
    """Share of characters in tags and in style rules, each on its own; 0 for an empty text."""
    t = col(c)
    css = F.when(F.contains(t, F.lit("{")), total_length(t, CSS)).otherwise(0)
    tags = F.when(F.contains(t, F.lit("<")), total_length(t, TAG)).otherwise(0)
    return F.when(F.length(t) == 0, 0.0).otherwise((tags + css) / F.length(t))


def unusual(c) -> Column:
    """What is left of a text without Latin letters, digits and blanks; neighbours that are left stay neighbours."""
    return F.regexp_replace(col(c), "[A-Za-z0-9 ]+", "")


def symbol_ratio(c, rest=None) -> Column:
    """Share of characters that are no letter, digit, white space or usual symbol; 1 for an empty text. rest: unusual(c), if it is there."""
    t = col(c)
    odd = F.length(F.regexp_replace(unusual(t) if rest is None else col(rest), rf"[\p{{L}}\p{{Nd}}{DIGITS}{WS}{in_class(K.ALLOWED_SYMBOLS)}]++", ""))
    return F.when(F.length(t) == 0, 1.0).otherwise(odd / F.length(t))


def has_symbol_run(c, least: int = 5, rest=None) -> Column:
    """rest: unusual(c), if it is there; a run stands in that too, where it is looked for first."""
    run = F.lit(rf"([^{LETTERS}{WS}])\1{{{least - 1}}}")
    return F.regexp_like(unusual(c) if rest is None else col(rest), run) & F.regexp_like(col(c), run)


def spelled_out(pattern: str, space: str, before: str, after: str) -> str:
    """A pattern whose white space and whose word edges at either end are put as given."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b").replace(r"\s", f"[{space}]")
    return (before if pattern.startswith(r"\b") else "") + inner + (after if pattern.endswith(r"\b") else "")


def boilerplate_patterns() -> list[str]:
    """As they are for Java: Unicode case folding; lines end at \\n alone for the one that starts a line."""
    plain = [spelled_out(p, WS, rf"(?<![{LETTERS}_])", rf"(?![{LETTERS}_])") for p in K.BOILERPLATE]
    return [("(?iumd)" if p.startswith("^") else "(?iu)") + p for p in plain]


def per_thousand(hits: Column, n: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(hits / n * 1000)


#: One of these is in what the pattern of the same place matches, lower-cased. No s: its long form matches but stays.
_PLATE_PARTS = [["tentang", "about"], ["baca"], ["gunakan"], ["facebook", "tter", "what"], ["erved"], ["hak"], ["letter"], ["letter"], ["menu", "nav"]]


def boilerplate_density(c, n: Column | None = None, lowered=None) -> Column:
    def hits(low: Column) -> Column:
        tried = [F.when(has_any(low, parts), F.regexp_count(col(c), F.lit(p))).otherwise(0) for parts, p in zip(_PLATE_PARTS, boilerplate_patterns(), strict=True)]
        return reduce(Column.__add__, tried)

    return per_thousand(let(F.lower(col(c)), hits) if lowered is None else hits(col(lowered)), word_count(c) if n is None else n)


def keyword_hits(lowered, keywords: list[str]) -> Column:
    """Occurrences of each keyword on its own, inside words too; the text is lower-cased already.

    Whether a keyword is there at all goes by bytes; patterns, which need the text decoded, only count.
    """
    t = col(lowered)
    return reduce(Column.__add__, [F.when(~F.contains(t, F.lit(k)), 0).otherwise(F.regexp_count(t, F.lit(k))) for k in keywords])


def keyword_density(lowered, keywords: list[str], n: Column) -> Column:
    return per_thousand(keyword_hits(lowered, keywords), n)


URL = rf"""https?://[^{WS}<>"]+|www\.[^{WS}<>"]+"""


#: One of these is in each URL.
_URL_PARTS = ["http", "www."]


def link_count(c) -> Column:
    return F.when(~has_any(c, _URL_PARTS), 0).otherwise(F.regexp_count(col(c), F.lit(URL)))


def has_any(lowered, keywords: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(col(lowered), F.lit(k)) for k in keywords])


def has_suspicious_domain(lowered) -> Column:
    inside = F.exists(F.regexp_extract_all(col(lowered), F.lit(URL), F.lit(0)), lambda u: has_any(u, K.SUSPICIOUS_DOMAINS))
    return F.when(~has_any(lowered, _URL_PARTS), False).otherwise(inside)


def dominant_share(lowered, own=None) -> Column:
    """Share of the most frequent word where it exceeds 0.4, else a lower bound of it; 0 without words. own: words(lowered), if they are there.

    A word with more than 0.4 n of n sorted places covers place 0, s or 2s for s = 0.4 n rounded down.
    """

    def share(own: Column) -> Column:
        n = F.size(own)
        step = F.floor(n * 4 / 10).cast("int")
        most = F.greatest(*[let(F.get(own, step * k), lambda w: F.size(F.filter(own, lambda x: x == w))) for k in range(3)])
        return F.when(n == 0, 0.0).otherwise(most / n)

    return let(F.sort_array(words(lowered) if own is None else col(own)), share)


def no_punctuation(c) -> Column:
    return ~F.regexp_like(col(c), F.lit("[.,?!]"))


def language_samples(c) -> Column:
    """The parts of a text that a detector sees; none of a short text."""
    t = col(c)
    parts = [F.substring(t, F.floor(F.length(t) * f).cast("int") + 1, F.lit(K.LANGUAGE_SAMPLE)) for f in K.LANGUAGE_SAMPLES]
    return F.when(F.length(t) < K.LANGUAGE_LEAST, F.array().cast("array<string>")).otherwise(F.filter(F.array(*parts), lambda s: F.length(s) >= K.LANGUAGE_LEAST_SAMPLE))


def language_vote(languages) -> Column:
    """Whether at least half of the detected languages are allowed; true without any."""
    found = F.array_compact(col(languages))
    good = F.size(F.filter(found, lambda x: x.isin(K.ALLOWED_LANGUAGES)))
    return (F.size(found) == 0) | (good * 2 >= F.size(found))


def format_prompt(c, user: str = K.CHAT_TAGS[0], end: str = K.CHAT_TAGS[1], assistant: str = K.CHAT_TAGS[2]) -> Column:
    return F.concat(F.lit(user), col(c), F.lit(end), F.lit(assistant))
