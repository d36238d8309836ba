"""Native operators against brute force over literal rows: nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import re
import struct

import pytest
import xxhash

from sievewright.llm import containment, curriculum, licenses

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(20_000))
TEXTS = [
    None, "", "one", "One TWO three four", "a b c d e f g h", LONG, "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "all rights\nreserved CC-BY 4.0 cc by", "x",
    "Émile ß İ K \U0001f600 wörter über alles", "a b c d e f g h", LONG, "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "all all rights reserved. ALL RIGHTS RESERVED", "  \t\n ", "SPDX-License-Identifier: MPL-2.0", "ccby cc byx accby",
]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, f"src{i % 4}" if i % 5 else None, "clash", "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, fingerprint string, size string, n_words int")


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute_sketch(text):
    words = text.lower().strip(" \t\n\x0b\x0c\r")
    words = re.split(r"[\x20\x09-\x0D]+", words) if words else []
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def chain(some):
        h = 42
        for x in some:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", x), h)
        return signed(h)

    if not words:
        return [signed(42)]  # the seed: nothing is chained
    every = sorted({chain(hashed[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {chain(hashed)})
    return [chain(hashed)] + [h for h in every if h < containment.LIMIT]


def brute_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    a, b = set(a[1:]), set(b[1:])
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("block", [2, 512])
def test_fingerprints(spark, block):
    ids = [3 * i * i + (1 << 40) * (i > 9) + (i << 58) * (i > 14) for i in range(len(TEXTS))]
    got = {r.doc_id: r for r in containment.fingerprint_edits(frame(spark, TEXTS, ids), block).collect()}
    assert len(got) == len(TEXTS)
    for k, given in enumerate(TEXTS):
        text, after = given or "", TEXTS[(k + 1) % len(TEXTS)] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        row, own, new = got[ids[k]], brute_sketch(text), brute_sketch(edited)
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == "".join(f"{h & (2**64 - 1):016x}" for h in own)
        assert row.edited_fingerprint == "".join(f"{h & (2**64 - 1):016x}" for h in new)
        assert row.near_edited == pytest.approx(brute_likeness(own, new))
        assert row.near_next == pytest.approx(brute_likeness(own, brute_sketch(after)))


def test_fingerprints_of_few_rows(spark):
    assert containment.fingerprint_edits(frame(spark, TEXTS).limit(0)).collect() == []
    lone = containment.fingerprint_edits(frame(spark, ["a b c d e f"])).first()
    assert lone.near_next == 1.0
    same = containment.fingerprint_edits(frame(spark, ["a b", "a b", None], [None, None, None])).collect()
    assert len(same) == 3


def test_blocks_are_bounded_whatever_the_ids(spark):
    """Stray ids, one id of a third of the rows, missing ids: no block is much larger than another, and none is lost."""
    rows = [(i, f"t{i}") for i in range(600)] + [(2**62 + 512 * i, f"s{i}") for i in range(5)] + [(77, f"h{i}") for i in range(500)] + [(None, f"n{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    blocks = containment.blocks_of(docs, 20)
    placed = docs.select("doc_id", "text", blocks.block(blocks.place()).alias("b")).collect()
    sizes = {}
    for r in placed:
        sizes[r.b] = sizes.get(r.b, 0) + 1
    assert max(sizes.values()) <= 60 and set(sizes) == set(range(len(blocks.bounds)))
    got = containment.next_document(docs, [("text", docs.text)], blocks).collect()
    key = {r.text: r.k for r in docs.selectExpr("text", "xxhash64(text) AS k").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key[r[1]]))
    want = {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    assert {r.text: r.next_text for r in got} == want and len(got) == len(rows)
    few = containment.blocks_of(docs, 20, 8)
    assert len(few.bounds) <= 16


def test_merged_sketches_contain_their_parts(spark):
    import pyspark.sql.functions as F

    rows = [(" ".join(f"a{k}x{i}" for i in range(14)), " ".join(f"b{k}x{i}" for i in range(14))) for k in range(50)]
    one, two = containment.sketch(F.col("a")), containment.sketch(F.col("b"))
    both = containment.merged(F.col("x"), F.col("y"))
    made = spark.createDataFrame(rows, "a string, b string").select(one.alias("x"), two.alias("y")).select("x", "y", both.alias("m"))
    for r in made.select("x", "y", "m", containment.containment(F.col("x"), F.col("m")).alias("c"), containment.likeness(F.col("x"), F.col("m")).alias("l")).collect():
        assert r.m == sorted({*r.x, *r.y}) and (r.c == 1.0 or not r.x)
        assert r.l == pytest.approx(len(r.x) / len(r.m) if r.m else 1.0)


def test_sketches_merge_and_contain(spark):
    import pyspark.sql.functions as F

    whole = " ".join(f"t{i}" for i in range(8000))
    part = " ".join(f"t{i}" for i in range(1000, 1600))
    row = spark.createDataFrame([(whole, part)], "a string, b string").select(containment.sketch(F.col("a")).alias("a"), containment.sketch(F.col("b")).alias("b"))
    row = row.select(containment.containment(F.col("a"), F.col("b")).alias("c"), containment.likeness(F.col("a"), F.col("b")).alias("l"), (containment.merged(F.col("a"), F.col("b")) == F.col("a")).alias("m")).first()
    assert row.c == 1.0 and row.m and 0.04 < row.l < 0.12


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        for s in over or free:
            out[s] = 2.0 * sizes[s] if over else left * weight[s] / total
        if not over:
            break
        for s in over:
            free.discard(s)
            left -= out[s]
    return out


def test_targets(spark):
    import random

    random.seed(5)
    for n in (1, 2, 3, 7, 40):
        sizes = {f"s{i:02}" if i else None: random.choice([0, 5, 5, random.randint(1, 10_000)]) for i in range(n)}
        got = curriculum.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
        want = brute_targets(sizes)
        assert {r.source: r.target for r in got} == pytest.approx(want)


def test_mixture(spark):
    docs = frame(spark, (TEXTS * 40)[:600])
    docs = docs.union(docs.limit(7))
    rows = curriculum.plan(docs).collect()
    assert rows and sorted(rows) == sorted(curriculum.plan(docs).collect())
    assert len(rows) == 607
    by_id = {r.doc_id: (r.source, r.text) for r in docs.collect()}
    total, largest, sizes, target = {}, {}, {}, {}
    for r in rows:
        source, text = by_id[r.doc_id]
        assert r.size == len(WORDS.findall(text or ""))
        assert r.taken in (0, r.size, 2 * r.size)
        assert all(0 <= p < 1 for p in r.positions)
        total[source] = total.get(source, 0) + r.taken
        sizes[source] = sizes.get(source, 0) + r.size
        largest[source] = max(largest.get(source, 0), r.size)
        target[source] = r.target
    assert target == pytest.approx(brute_targets(sizes))
    for source, taken in total.items():
        assert abs(taken - target[source]) <= largest[source] / 2 + 1
    first = [min(r.positions, default=2.0) for r in rows]
    assert first == sorted(first)


def test_positions_by_brute_force(spark):
    """Every document's readings and their places, source by source, one document after the other."""
    import math

    rows = [(i, " ".join(["w"] * (i * 37 % 23)), None if i % 11 == 5 else f"s{i * i % 5}") for i in range(500)] + [(7, "x y", "s1"), (7, "x y", "s1")]
    got = curriculum.plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    sizes = {}
    for _, t, source in rows:
        sizes[source] = sizes.get(source, 0) + len(t.split())
    target, order = brute_targets(sizes), sorted(s for s in sizes if s is not None) + [None]
    buckets, want = max(curriculum.BUCKETS, math.isqrt(len(rows))), []
    for k, source in enumerate(order):
        own = []
        for i, t, s in rows:
            if s == source:
                h = 42
                for x in (i, len(t.split())):
                    h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
                own.append((signed(h) % buckets, signed(h), i, len(t.split())))
        before, tilt = 0, curriculum.TILTS[k % 3]
        for _, _, i, size in sorted(own):
            places = []
            for p in range(2):
                demand = (p * sizes[source] + before + size / 2) / target[source]
                if size and demand < 1:
                    low, high = 0.0, 1.0
                    for _ in range(60):
                        middle = (low + high) / 2
                        low, high = (middle, high) if middle + tilt * (middle**2 - middle) < demand else (low, middle)
                    places.append(low)
            want.append((i, size, source, len(places) * size, places))
            before += size
    assert len(got) == len(want)
    for a, b in zip(sorted((r.doc_id, r["size"], r.source_size, r.taken, r.positions) for r in got), sorted((i, n, sizes[s], taken, places) for i, n, s, taken, places in want)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-9)


def test_mixed_documents(spark):
    docs = frame(spark, TEXTS)
    out = curriculum.mix(docs)
    assert out.columns == [*docs.columns, "position", "pass"]
    want = {(r.doc_id, k): p for r in curriculum.plan(docs).collect() for k, p in enumerate(r.positions)}
    rows = out.collect()
    assert {(r.doc_id, r["pass"]): r.position for r in rows} == want and len(rows) == len(want)
    assert [r.position for r in rows] == sorted(want.values())
    assert curriculum.mix(out).columns == out.columns
    assert curriculum.mix(docs.limit(0)).collect() == []


def test_position_inverts_demand(spark):
    import pyspark.sql.functions as F

    rows = spark.range(101).select((F.col("id") / 100.0).alias("d"))
    for tilt in (-0.5, 0.0, 0.25, 0.75):
        for r in rows.select("d", curriculum.position(F.col("d"), F.lit(tilt)).alias("t")).collect():
            assert r.t + tilt * (r.t**2 - r.t) == pytest.approx(r.d)


def brute_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        own = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += found
        labels |= {label} if found else set()
    line = " " + " ".join(words) + " "
    spans = set()
    for label, pattern, _, rank, score in licenses.rules():
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line):
            start = line[: m.start()].count(" ") - 1
            spans.add((label, start, start + m[0].count(" ") + 1, rank, score))
    kept = [s for s in spans if not any(t[1] <= s[1] and s[2] <= t[2] and (t[3] > s[3] or (t[3] == s[3] and t[2] - t[1] > s[2] - s[1])) for t in spans)]
    best = max([s[4] for s in kept] + [licenses.BASE_SCORE if labels else 0.0])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in kept})), best


def test_scan(spark):
    more = [f"Before. {a} {b} after" for a in ("Licensed under", "released UNDER the") for b in ("GPL v2 or any later version", "MIT License", "BSD-style license", "CC BY-NC-SA 4.0", "Creative Commons Attribution 4.0 International", "Mozilla Public License 2.0; Apache License 2.0, MPL 1.1")]
    texts = TEXTS + more
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute_scan(text), text
    assert licenses.scan(frame(spark, texts).limit(0)).collect() == []


def written(parsed, longest):
    """A text of the pattern, without its optional parts or with them all; classes give their first or last character."""
    out = ""
    for op, value in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op == "IN":
            kind, chars = value[-1 if longest else 0]
            out += chr(chars if str(kind) == "LITERAL" else chars[1 if longest else 0])
        elif op == "BRANCH":
            out += (max if longest else min)((written(b, longest) for b in value[1]), key=len)
        elif op == "SUBPATTERN":
            out += written(value[-1], longest)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += written(value[2], longest) * min(value[1] if longest else value[0], 80)
        elif op == "ANY":
            out += "a "[longest and len(out) % 2]
        else:
            raise ValueError(op)
    return out


def test_every_rule_is_reached():
    """Texts of each pattern, shortest and longest: the gate and the keys of the rule let them through."""
    assert len(licenses.rules()) > 400
    for _, pattern, keys, *_ in licenses.rules():
        parsed = re._parser.parse(pattern)
        assert written(parsed, True).count(" ") < licenses.WIDEST and "*" not in pattern
        for longest in (False, True):
            text = written(parsed, longest)
            line = f" {text} "
            assert re.fullmatch(pattern, text), (pattern, text)
            assert all(k in line for k in keys), (pattern, text, keys)
            assert any(all(w in text for w in g) for g in licenses.gates()), text
    assert all(any(all(w in p for w in g) for g in licenses.gates()) for p, _ in licenses.BASE)


NAMED = {
    "SIL Open Font 1.1": "ofl-1.1", "GNU Free Documentation 1.3": "gfdl-1.3", "Python Software Foundation 2.0": "psf-2.0", "Open Software 3.0": "osl-3.0", "Boost Software 1.0": "bsl-1.0",
    "GPLv3": "gpl-3", "gplv2 or later": "gpl-2-or-later", "LGPLv2.1": "lgpl-2.1", "AGPLv3": "agpl-3", "Apache2": "apache-2", "under GPL-3.0": "gpl-3.0", "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
}


def test_names_alone(spark):
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(frame(spark, list(NAMED))).collect()}
    for k, label in enumerate(NAMED.values()):
        assert label in got[k], (k, label, got[k])


def test_many_matches_in_one_text(spark):
    text = "MIT License, GPL v2 or any later version; GPLv3 and all rights reserved. Creative Commons Attribution 4.0 International " * 400
    r = licenses.scan(frame(spark, [text])).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute_scan(text)
    assert r.detections.count(",") > 1500
