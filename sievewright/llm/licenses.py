"""License scans (operator 8). DataFrame functions only.

Texts become words: A-Z lower-cased, then runs of digits, letters and all that isn't ASCII. Three base phrases are
counted wherever their words stand one after the other. The method adds signature rules: hundreds of regular
expressions over the words, in order of priority, made from the families below. A rule is tried only on lines that
hold its keys, which its pattern implies; a text is looked at only if it holds the words of some rule's first key. Each match is an interval of words; an
interval inside another of higher priority, or inside a longer one of the same priority, is suppressed, so that a
grant with its version outranks the bare name inside it.

Defined results: a null or empty text has no words, counts 0, null first and last word, empty labels and score 0;
repeated rows are scanned each; extra columns are ignored; an empty table gives an empty result. The score is that of
the surest match left: a base phrase alone counts BASE_SCORE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm._batches import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, character by character: a class of single characters is a table look-up, one of ranges is not.
_APART = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
OTHER, WORD = f"[{_APART}]+", f"[^{_APART}]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_SCORE = 0.5

#: label: (written names as word patterns, versions as word patterns, keyword that every name holds).
VERSIONED = {
    "apache": (("apache(?: software)?", "asl"), ("1 0", "1 1", "2 0", "2"), ("apache", "asl")),
    "gpl": (("gnu general public", "gpl", "gnu gpl"), ("1", "2", "3", "1 0", "2 0", "3 0"), ("general public", "gpl", "gpl")),
    "lgpl": (("gnu lesser general public", "gnu library general public", "lgpl"), ("2", "2 1", "3", "2 0", "3 0"), ("lesser general", "library general", "lgpl")),
    "agpl": (("gnu affero general public", "agpl"), ("1", "3", "1 0", "3 0"), ("affero", "agpl")),
    "mpl": (("mozilla public", "mpl"), ("1 0", "1 1", "2 0"), ("mozilla public", "mpl")),
    "epl": (("eclipse public", "epl"), ("1 0", "2 0"), ("eclipse public", "epl")),
    "cddl": (("common development and distribution", "cddl"), ("1 0", "1 1"), ("common development", "cddl")),
    "eupl": (("european union public", "eupl"), ("1 0", "1 1", "1 2"), ("european union", "eupl")),
    "osl": (("open software", "osl"), ("1 0", "2 0", "2 1", "3 0"), ("open software", "osl")),
    "afl": (("academic free", "afl"), ("1 1", "1 2", "2 0", "2 1", "3 0"), ("academic free", "afl")),
    "artistic": (("artistic",), ("1 0", "2 0"), ("artistic",)),
    "ofl": (("sil open font", "ofl"), ("1 0", "1 1"), ("open font", "ofl")),
    "psf": (("python software foundation", "psf"), ("2", "2 0"), ("python software", "psf")),
    "php": (("php",), ("3 0", "3 01"), ("php",)),
    "cpl": (("common public", "cpl"), ("0 5", "1 0"), ("common public", "cpl")),
    "cecill": (("cecill",), ("1 0", "1 1", "2 0", "2 1"), ("cecill",)),
    "gfdl": (("gnu free documentation", "gfdl"), ("1 1", "1 2", "1 3"), ("free documentation", "gfdl")),
    "bsl": (("boost software", "bsl"), ("1 0",), ("boost software", "bsl")),
}
CREATIVE = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CREATIVE_NAMES = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CREATIVE_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: label: (pattern, keyword, score) of licences without versions and of their well-known sentences.
PLAIN = {
    "mit": (("(?:the )?(?:mit|expat|x11) licen[sc]e", "licen", 0.9), ("permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 0.95), ("under mit", "under mit", 0.8), ("under the mit", "under the mit", 0.8), ("under the terms of (?:the )?mit", "under the terms of", 0.8)),
    "bsd": (("(?:new |modified |simplified |revised )?bsd(?: style)? licen[sc]e", " bsd", 0.9), ("redistribution and use in source and binary forms", "redistribution and use", 0.95), ("neither the name of .{1,80}? nor the names of its contributors", "neither the name", 0.9)),
    "isc": (("isc licen[sc]e", " isc ", 0.9), ("permission to use copy modify and (?:or )?distribute this software for any purpose", "permission to use", 0.9)),
    "zlib": (("zlib(?: libpng)? licen[sc]e", "zlib", 0.9), ("this software is provided as is without any express or implied warranty in no event will the authors", "in no event will the authors", 0.8)),
    "unlicense": (("(?:the )?unlicen[sc]e", "unlicen", 0.9), ("this is free and unencumbered software released into the public domain", "unencumbered", 0.95)),
    "wtfpl": (("wtfpl", "wtfpl", 0.9), ("do what the fuck you want to public license", "public license", 0.95)),
    "cc0": (("cc0(?: 1 0)?(?: universal)?", "cc0", 0.9), ("creative commons zero", "commons zero", 0.9)),
    "public-domain": (("(?:released|placed|dedicated|is) (?:in|into|to) the public domain", "public domain", 0.8), ("public domain dedication", "public domain", 0.8)),
    "proprietary": (("proprietary and confidential", "proprietary", 0.8), ("unauthori[sz]ed copying of this file", "unauthori", 0.8), ("no part of this (?:publication|work|book|document) may be reproduced", "may be reproduced", 0.8), ("(?:not|may not be) (?:re)?distributed without (?:prior |express ){0,3}(?:written )?permission", "distributed without", 0.6)),
    "copyright": (("copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", "copyright", 0.4), ("© (?:19|20)[0-9]{2}", "©", 0.4)),
    "reserved": (("all rights reserved", "rights reserved", 0.5), ("(?:some|no) rights reserved", "rights reserved", 0.5)),
    "licensed": (("licen[sc]ed under (?:the )?[a-z0-9]+", "licen", 0.3), ("(?:released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?[a-z0-9]+ licen[sc]e", "licen", 0.3), ("see (?:the )?licen[sc]e(?: file| txt| md)?", "licen", 0.2)),
}


def rules() -> list[tuple[str, str, tuple[str, ...], int, float]]:
    """(label, pattern over words, what the line holds wherever the pattern matches, priority, score); the first matters most.

    Tables and version lists above stand for the rules that differ in a name or a number only.
    """
    out = []
    licence = "(?: licen[sc]e)?"
    for label, (names, versions, keys) in VERSIONED.items():
        for name, key in zip(names, keys, strict=True):
            glued = "|v?" if len(key) < 7 else ""  # as in gplv3
            key = f" {key}"
            for v in versions:
                tag, end = f"{label}-{v.replace(' ', '.')}", f"{v} "
                dated = f"{name}(?:{licence} (?:version |v ?)?{glued}){v}"
                out.append((f"{tag}-or-later", f"{dated}(?: of the licen[sc]e)? or (?:at your option )?(?:any )?later", (key, " later ", end), 90, 1.0))
                out.append((tag, dated, (key, end), 80, 0.95))
            out.append((label, f"{name} licen[sc]e", (key, " licen"), 60, 0.85))
            if len(name) < 6:
                out.append((label, f"(?:under|of|by) (?:the )?(?:gnu )?{name}", (f"{key} ",), 50, 0.6))
        for v in versions:
            out.append((f"{label}-{v.replace(' ', '.')}", f"spdx licen[sc]e identifier {label} {v}(?: only)?", (" spdx licen", f"{v} "), 95, 1.0))
    for kind in CREATIVE:
        tag, named = f"cc-{kind.replace(' ', '-')}", " ".join(CREATIVE_NAMES[p] for p in kind.split())
        for v in CREATIVE_VERSIONS:
            out.append((f"{tag}-{v.replace(' ', '.')}", f"cc {kind} {v}", (f" cc {kind} ", f"{v} "), 90, 0.95))
            out.append((f"{tag}-{v.replace(' ', '.')}", f"(?:creative commons )?{named} {v}(?: international| unported| generic)?", (" attribution ", f" {v} "), 85, 0.9))
        out.append((tag, f"cc {kind}", (f" cc {kind} ",), 70, 0.8))
        out.append((tag, f"creative commons {named}", (" creative commons ",), 70, 0.8))
    for label, some in PLAIN.items():
        out += [(label, pattern, (key,), 40 if score < 0.6 else 65, score) for pattern, key, score in some]
    return sorted(out, key=lambda r: -r[3])


def gates() -> list[tuple[str, ...]]:
    """Sets of words; a text that holds no set, A-Z lower-cased, has no match of a rule or base phrase.

    They are the words of the rules' first keys. A set that holds another one adds nothing and is left out.
    """
    sets = {frozenset(key.split()) for key in [*(r[2][0] for r in rules()), *(p for p, _ in BASE)]}
    return sorted(tuple(sorted(s, key=lambda w: (-len(w), w))) for s in sets if not any(t < s for t in sets))


#: Stand before a match and its rule's number, between number and match, and behind the match; no word holds them.
OPENS, SAYS, CLOSES = "\x01", "\x02", "\x03"
#: No match has as many words, so a match that holds another starts in the same block of so many words or the one before.
WIDEST = 128


def _listed(values, kind: str) -> str:
    """SQL: array of values, as one literal that is parsed once."""
    return f"cast(split('{','.join(map(str, values))}', ',') AS array<{kind}>)"


def _marked() -> str:
    """SQL: of each rule whose keys the line x holds, the line with its matches marked.

    Patterns are literals, so each is compiled once, and a rule is tried only behind its keys. A match stands behind one
    blank and before another; the look-ahead leaves that to the next match.
    """
    by_key: dict[str, list[str]] = {}
    for k, (_, pattern, (key, *others), *_) in enumerate(rules()):
        tried = f"regexp_replace(x, r' ({pattern})(?= )', ' {OPENS}{k}{SAYS}$1{CLOSES}')"
        behind = " AND ".join(f"contains(x, '{o}')" for o in others)
        by_key.setdefault(key, []).append(f"CASE WHEN {behind} THEN {tried} END" if others else tried)
    each = ", ".join(f"CASE WHEN contains(x, '{key}') THEN array({', '.join(own)}) END" for key, own in by_key.items())
    return f"filter(flatten(array_compact(array({each}))), m -> contains(m, '{OPENS}'))"


def _spans() -> str:
    """SQL: (start, end, rule) of all matches in the line x, in words, in order."""
    words = "split(substring(m, 2), ' ')"
    begins = f"filter(transform(w, (v, i) -> CASE WHEN startswith(v, '{OPENS}') THEN named_struct('at', i, 'rule', cast(substring_index(substring(v, 2), '{SAYS}', 1) AS int)) END), i -> i IS NOT NULL)"
    ends = f"filter(transform(w, (v, i) -> CASE WHEN endswith(v, '{CLOSES}') THEN i END), i -> i IS NOT NULL)"
    pairs = f"zip_with({begins}, {ends}, (a, b) -> named_struct('start', a.at, 'end', b + 1, 'rule', a.rule))"
    return f"array_sort(flatten(transform({_marked()}, m -> element_at(transform(array({words}), w -> {pairs}), 1))))"


def _kept(spans: str) -> str:
    """SQL: matches that aren't inside another of higher priority, or inside a longer one of the same; by blocks of words."""
    of = lambda k, kind: f"get({_listed((r[k] for r in rules()), kind)}, s.rule)"
    known = f"array_distinct(transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 'label', {of(0, 'string')}, 'rank', {of(3, 'int')}, 'score', {of(4, 'double')})))"
    inside = "t.start <= s.start AND s.end <= t.end AND (t.rank > s.rank OR (t.rank = s.rank AND t.end - t.start > s.end - s.start))"
    block = lambda b: f"filter(a, s -> s.start div {WIDEST} = {b})"
    blocks = f"array_distinct(transform(a, s -> s.start div {WIDEST}))"
    pairs = f"transform({blocks}, b -> named_struct('own', {block('b')}, 'before', {block('b - 1')}))"
    kept = f"filter(p.own, s -> NOT exists(p.own, t -> {inside}) AND NOT exists(p.before, t -> {inside}))"
    return f"element_at(transform(array({known}), a -> flatten(transform({pairs}, p -> {kept}))), 1)"


def _phrase(words: Column, phrase: str) -> Column:
    """Starts of the phrase's words one after the other."""
    own = phrase.split(" ")
    stands = lambda i: reduce(Column.__and__, [F.get(words, i + k) == w for k, w in enumerate(own)])
    last = F.size(words) - len(own)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), stands)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections of each row."""
    text = F.coalesce("text", F.lit(""))
    any_gate = " OR ".join("(" + " AND ".join(f"contains(low, '{w}')" for w in g) + ")" for g in gates())
    line = F.expr(f"element_at(transform(array(low), low -> CASE WHEN {any_gate} THEN concat(' ', btrim(regexp_replace(low, r'{OTHER}', ' ')), ' ') END), 1)")
    lowered = docs.select("doc_id", F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_words"), F.translate(text, UPPER, LOWER).alias("low"))
    rows = lowered.select("doc_id", "n_words", line.alias("line"))
    none = F.array().cast("array<int>")

    def based(line: Column) -> Column:
        words = F.filter(F.split(line, " "), lambda w: w != "")
        return let(words, lambda w: F.array(*[F.struct(F.lit(label).alias("label"), F.when(F.contains(line, F.lit(f" {p} ")), _phrase(w, p)).otherwise(none).alias("at")) for p, label in BASE]))

    base = F.when(reduce(Column.__or__, [F.contains("line", F.lit(f" {p} ")) for p, _ in BASE]), F.filter(let(F.col("line"), based), lambda b: F.size(b["at"]) > 0))
    kept = F.expr(f"CASE WHEN line IS NOT NULL THEN element_at(transform(array(line), x -> {_kept(_spans())}), 1) END")
    seen = rows.select("doc_id", "n_words", base.alias("base"), kept.alias("kept"))
    nothing = F.array().cast("array<string>")
    starts = F.flatten(F.col("base.at"))
    base_labels = F.coalesce(F.transform("base", lambda b: b["label"]), nothing)
    labels = F.array_union(base_labels, F.coalesce(F.transform("kept", lambda s: s["label"]), nothing))
    best = F.greatest(F.coalesce(F.array_max(F.transform("kept", lambda s: s["score"])), F.lit(0.0)), F.when(F.size(base_labels) > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)))
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    detections = F.coalesce(F.array_join(F.transform(F.array_sort(F.transform("kept", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["label"].alias("c")))), lambda s: F.concat_ws(":", s["c"], s["a"], s["b"])), ","), F.lit(""))
    return seen.select(
        "doc_id", "n_words", F.coalesce(F.size(starts), F.lit(0)).cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        listed(base_labels).alias("base_labels"), listed(labels).alias("labels"), best.alias("score"), detections.alias("detections"),
    )
