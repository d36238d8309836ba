"""Operators with Python workers against brute force, libraries, round trips and held-out rows."""

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievewright.llm import bpe, pii, quality, simhash, tokencount, vafile
from sievewright.llm._vocab import PATTERN, locate
from sievewright.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", "a", "  ", "\n\n  x", "Hello  World! it's 123 ÀÉ\n\x00 x\x1cy <|endoftext|> a<|startoftext|>b", "İK ß ﬁ ΑΣ ΣΑΣ", "áb ​ c ﻿", " 'S x's DON'T", "१२३ ⅷ x²", "…—!!!",
    "a" * 640, "ab" * 3000, "日本語テキスト" * 30, "🎉👩‍👩‍👧" * 5, "ﬀ Å Å é é", "!" * 500, "\t\t\n \r\n x  y   z", "한국어 텍스트", "Hello  World! it's", "a" * 640,
]


def frame(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}", 9.9, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double, fp string, ids string")


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_byte_pairs_as_the_library(spark, texts):
    import tiktoken

    with open(locate(BYTE_VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_documents(frame(spark, texts), BYTE_VOCABULARY, with_ids=True).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[k].ids == ids and got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(frame(spark, texts).limit(0), BYTE_VOCABULARY).collect() == []


def test_byte_pairs_forget_and_go_on(monkeypatch, texts):
    own = bpe.ByteBPE(BYTE_VOCABULARY)
    want = own.encode([t or "" for t in texts])
    monkeypatch.setattr(bpe, "MEMO", 10)
    for part in (texts[:40], texts[40:]):
        own.encode([t or "" for t in part])
    again = own.encode([t or "" for t in texts])
    assert all((a == b).all() for a, b in zip(want, again, strict=True))


def test_token_counts_as_the_library(spark, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(locate(WORD_VOCABULARY))
    got = {r.doc_id: r for r in tokencount.count_tokens(frame(spark, texts), WORD_VOCABULARY, limit=200).collect()}
    for k, t in enumerate(texts):
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 200), repr(t)[:60]
    assert tokencount.count_tokens(frame(spark, texts).limit(0), WORD_VOCABULARY).collect() == []


def unbroken():
    """Long texts without a place to split: runs, two letters, many letters, several bytes a letter, word parts; odd lengths around a row."""
    rng = random.Random(8)
    some = ["".join(rng.choices(alphabet, k=n)) for alphabet, n in (("a", 5001), ("ab", 8000), ("abcdefghijklmnopqrstuvwxyz", 9000), ("éüñßaeiounst", 6000), ("日本語テキスト漢字仮名交", 4000), ("!?.,;-", 5000), (["the", "ing", "tion", "and", "al"], 4000))]
    return some + [c * k for k in (127, 128, 129, 191, 192, 193, 257) for c in ("a", "!", "ab")] + ["".join(rng.choices("aab", k=k)) for k in range(126, 200)]


def test_unbroken_pieces_as_the_libraries():
    import tiktoken
    from tokenizers import Tokenizer

    with open(locate(BYTE_VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    bytewise, wordwise = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(locate(WORD_VOCABULARY))
    own, counts = bpe.ByteBPE(BYTE_VOCABULARY), tokencount.WordBPE(WORD_VOCABULARY)
    assert own.in_order and counts.at_once
    texts = unbroken()
    ids, bounds = own.encode(texts)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == bytewise.encode_ordinary(text), text[:40]
    assert counts.count(texts).tolist() == [len(wordwise.encode(t, add_special_tokens=False).ids) for t in texts]
    own.in_order = False
    assert all((own._folded(t.encode()) == ids[bounds[k] : bounds[k + 1]]).all() for k, t in enumerate(texts) if " " not in t and 128 < len(t.encode()) < 300)


@pytest.mark.parametrize("letters", ["a", "abcdefghijklmnopqrstuvwxyz"])
def test_a_megabyte_without_a_break_takes_seconds(letters):
    text = "".join(random.Random(9).choices(letters, k=1 << 20))
    began = time.perf_counter()
    assert len(bpe.opened(BYTE_VOCABULARY).encode([text])[0]) > 1000 and tokencount.opened(WORD_VOCABULARY).count([text])[0] > 1000
    assert time.perf_counter() - began < 120


def test_memos_are_bounded_in_characters(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_CHARS", 100), monkeypatch.setattr(tokencount, "MEMO_CHARS", 100)
    own, counts = bpe.ByteBPE(BYTE_VOCABULARY), tokencount.WordBPE(WORD_VOCABULARY)
    for k in range(5):
        own.encode(["x" * (150 + k)]), counts.count(["x" * (150 + k)])
        assert own.memo.held < 200 and counts.memo.held < 200


def test_counts_one_merge_at_a_time():
    own = tokencount.WordBPE(WORD_VOCABULARY)
    pieces = [p.encode() for p in ("aaaaaaa", "bananarama", "x", "thethethe", "ßéé" * 9)]
    at_once = own.survivors(pieces)
    own.at_once = False
    assert (own.survivors(pieces) == at_once).all()


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_fingerprints_of_long_texts(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    some = [long, long + " tail", "x" * 2_000_000, "a " * 300_000, None, ""]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, some)).collect()}
    prints = [brute_fingerprint(t) for t in some]
    assert [got[k].fingerprint for k in range(len(some))] == [f"{p:016x}" for p in prints]
    assert [got[k].component_id for k in range(len(some))] == brute_components(prints)


def brute_components(prints):
    label = list(range(len(prints)))
    for _ in prints:
        before = list(label)
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= 2:
                    label[i] = min(label[i], label[j])
        if before == label:
            return label
    return label


def test_near_duplicates(spark, texts):
    some = texts[:90] + ["", None, texts[30], texts[30] + " tail"]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, some)).collect()}
    prints = [brute_fingerprint(t) for t in some]
    assert [got[k].fingerprint for k in range(len(some))] == [f"{p:016x}" for p in prints]
    assert [got[k].component_id for k in range(len(some))] == brute_components(prints)
    assert simhash.near_duplicates(frame(spark, some).limit(0)).collect() == []


def test_chains_across_crowded_keys(spark):
    random.seed(6)
    base = [random.getrandbits(64) for _ in range(6)]
    prints = []
    for b in base:
        for _ in range(40):
            b ^= (1 << random.randrange(64)) | (1 << random.randrange(64) if random.random() < 0.4 else 0)
            prints.append(b)
    prints += [base[0] ^ (0xFFFF << 48) ^ x for x in range(120)]
    prints = sorted(set(prints))
    reps = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp bigint")
    pairs = simhash.links(reps, run=16).collect()
    at = {p - 2**64 if p >= 2**63 else p: k for k, p in enumerate(prints)}
    label = simhash.roots(len(prints), np.array([at[r.a] for r in pairs]), np.array([at[r.b] for r in pairs]))
    assert label.tolist() == brute_components(prints)
    edges = spark.createDataFrame([(at[r.a], at[r.b]) for r in pairs], "u bigint, v bigint")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert [found.get(k, k) for k in range(len(prints))] == label.tolist()


def test_one_of_each_group_stays(spark, texts):
    some = texts[:60] + ["", None, texts[30]]
    docs = frame(spark, some)
    docs = docs.union(docs.limit(3))
    kept = simhash.keep_one(docs)
    label = brute_components([brute_fingerprint(t) for t in some])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    assert kept.columns == docs.columns


def brute_spans(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark, texts):
    random.seed(2)
    noise = ["".join(random.choice("ab1234567890@@..+-- ()4") for _ in range(random.randint(0, 60))) for _ in range(3000)]
    some = texts + noise + ["4111 1111 1111 1111 and 4111-1111-1111-1111", "1.2.3.4.5.6.7.8 0001.2.3.255", "a@b@c.d@e.f a@b.c.@d.e", "é 🎉 x@y.zz", "IBAN DE89 3704 0044 0532 0130 00 bank", "iban DE89 3704 0044 0532 0130 01", "ssn 078-05-1120", "part 078-05-1120"]
    got = {r.doc_id: r for r in pii.detect(frame(spark, some)).collect()}
    for k, t in enumerate(some):
        want = brute_spans(t or "")
        r = got[k]
        listed = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == kind for x in want) for kind in pii.BASE]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE] == [s for s in listed.split(",") if s]
    assert "iban" in got[len(some) - 4].spans and "iban" not in got[len(some) - 3].spans
    assert "ssn" in got[len(some) - 2].spans and "ssn" not in got[len(some) - 1].spans
    assert pii.detect(frame(spark, some).limit(0)).collect() == []


def test_personal_data_in_long_texts():
    assert pii.find_spans("9" * 200_000) == [] and pii.find_spans("a" * 200_000 + "@") == []
    assert pii.find_spans("+1" + "(" * 100_000) == []


def test_addresses_of_many_zeros():
    zeros = "0" * 5000
    assert pii.find_spans(f"ip {zeros}.0.1.1") == [("ip", 3, 3 + 5000 + 6, 0.9)]
    assert [x[0] for x in pii.find_spans(f"{zeros}256.1.1.1 {zeros}255.1.1.{zeros}")] == ["ip"]


@pytest.mark.parametrize("iban", ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "AT611904300234573201"])
@pytest.mark.parametrize("tail", ["", " BIC CAIXESBB", " BANK", " A", ", x", " 12", ". ES91"])
def test_ibans_end_where_their_country_says(iban, tail):
    found = [x for x in pii.find_spans(f"x {iban}{tail}") if x[0] == "iban"]
    assert [(x[1], x[2]) for x in found] == [(2, 2 + len(iban))]
    assert not [x for x in pii.find_spans(f"x {iban}7{tail}") if x[0] == "iban"]
    wrong = iban[:-1] + str((int(iban[-1]) + 1) % 10)
    assert not [x for x in pii.find_spans(f"x {wrong}{tail}") if x[0] == "iban"]
    assert not [x for x in pii.find_spans(f"x QQ{iban[2:]}{tail}") if x[0] == "iban"]


def test_redaction(spark):
    docs = spark.createDataFrame([(0, "mail a@b.cc or 4111 1111 1111 1111.", "s", 35), (1, None, "s", 0), (2, "clean", "s", 5)], "doc_id bigint, text string, source string, n_chars bigint")
    out = pii.redact(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(0, "mail [EMAIL] or [CARD].", "s", 23), (1, None, "s", 0), (2, "clean", "s", 5)]


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels))
    rows = scored.join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    told = [r for r in rows if r.held_out and r.quality is not None]
    good, bad = ([r.score for r in told if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in told]) > 0.93


def test_word_vectors_as_plain_sums(spark):
    """Random indexing over the whole table, added up word by word."""
    import pyarrow as pa

    texts = ["The cat sat, the CAT ran!", "a dog ran away...", None, "", "dog dog dog", "über große Wörter und Straßen"] * 3
    words = quality.learn_words(frame(spark, texts).repartition(3))
    places, signs = quality.index_vectors()
    counts, sums = np.zeros(quality.BUCKETS), np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        _, bucket, _ = quality.word_stream(pa.array([t], pa.string()))
        for k, b in enumerate(bucket.tolist()):
            counts[b] += 1
            for j in (k - 1, k + 1):
                if 0 <= j < len(bucket):
                    for p, s in zip(places[bucket[j]], signs[bucket[j]]):
                        sums[b, p] += s
    want = quality.Words.of(counts, sums)
    assert np.allclose(words.vectors, want.vectors) and np.allclose(words.weights, want.weights)
    doc, bucket, n = quality.word_stream(pa.array(["one Two", None, "x"], pa.string()))
    assert n == 3 and set(doc.tolist()) == {0, 2} and len({b for d, b in zip(doc.tolist(), bucket.tolist()) if d == 0 and b >= quality.SHAPES}) == 2


def test_temperature_calibrates():
    """Overconfident logits: the temperature brings probabilities near the shares that hold, on rows that neither saw."""
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (12_000, quality.DIM + quality.SHAPES + 2))
    chance = 1 / (1 + np.exp(-1.2 * (x[:, 0] + 0.5 * x[:, 1])))
    y = (rng.random(len(x)) < chance).astype(np.int64)
    net = quality.fit(x[:4000], y[:4000], np.arange(4000) % 5 == 0)
    p = net.probabilities(x[4000:])
    loss = lambda q: -np.mean(np.log(np.where(y[4000:] == 1, q, 1 - q)))
    hot = 1 / (1 + np.exp(-np.clip(net.logits(x[4000:]), -40, 40)))
    cells = np.digitize(p, np.linspace(0, 1, 11))
    error = sum(abs(p[cells == c].mean() - y[4000:][cells == c].mean()) * (cells == c).mean() for c in np.unique(cells))
    assert error < 0.05 and loss(p) <= loss(hot) + 1e-3


def test_quality_of_long_texts(spark):
    long = ["word " * 400_000, "x" * 3_000_000, "!?" * 500_000, None, "short text"]
    docs = frame(spark, long)
    none = spark.createDataFrame([(0, 1, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, none)).collect()}
    assert len(got) == 5 and all(0 <= s <= 1 for s in got.values())


def test_quality_of_odd_rows(spark, texts):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (2, 0, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, one)
    a, b = ({r.doc_id: r.score for r in quality.score(d, model).collect()} for d in (docs, docs.repartition(3)))
    assert a == b and len(a) == len(ODD) and a[11] == a[20]
    kept = quality.keep_good(docs, model, 0.0)
    assert kept.count() == len(ODD) and kept.columns == docs.columns
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), none)).collect() == []


def brute_top(rows, k):
    good = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % 100 == 0:
            near = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("block", [1, 4096])
def test_top_k(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 16).round(1 if i % 2 else 6)]) for i in range(405)]
    rows += [(500, None), (600, []), (601, [1.0, None]), (602, [float("nan")] * 16), (700, [float("inf")] * 16), (800, [1.0, 2.0]), (801, [3.0, -1.0]), (None, [0.5] * 16), (900, [0.0] * 16)]
    frame_ = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, score string")
    got = vafile.search(frame_, F.col("vec_id") % 100 == 0, block=block).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 10) and len(got) == len({tuple(r) for r in got})
    assert vafile.search(frame_.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_exact_vectors_are_read_for_survivors_only(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.125, 64)]) for i in range(4000)]
    rows += [(4000 + i, rows[7][1]) for i in range(500)]  # copies
    given = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("vec_id", "xxhash64(embedding) AS key", "embedding")
    grid = vafile.grid_of(given)
    table = vafile.approximations(given, grid, 10)
    assert table.count() == 4000 + 10  # eleven of the copies
    assert {len(r.cells) for r in table.limit(5).collect()} == {64}
    asks = [rows[i] for i in (0, 100, 200, 300, 7)]
    left = vafile.survivors(table, grid, asks, 10)
    assert left.count() <= 5 * 20 and "embedding" not in left.columns
    # Bounds hold for every row, and what is taken in order of the upper bound ends early.
    v = vafile.whole(np.array([r[1] for r in rows]))
    for r in left.collect():
        assert r.lower <= v[asks[r.query][0]] @ v[r.vec_id] <= r.upper
    taken = []
    real = vafile._dot
    many = [(0, int(vec), float(u), e) for vec, u, e in sorted(((i, v[0] @ v[i] + 9, rows[i][1]) for i in range(1, 4000)), key=lambda x: -x[1])]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([m[0] for m in many], pa.int32()), pa.array([m[1] for m in many]), pa.array([m[2] for m in many]), pa.array([m[3] for m in many], pa.list_(pa.float32()))], names=["query", "vec_id", "upper", "embedding"])
    vafile._dot = lambda q, x: taken.append(len(x)) or real(q, x)
    try:
        (out,) = list(vafile.certain(asks, 10)(iter([batch])))
    finally:
        vafile._dot = real
    assert sum(taken) <= 64
    want = sorted((-int(v[0] @ v[i]), i) for i in range(1, 4000))[:10]
    assert list(zip(out.column("score").to_pylist(), out.column("vec_id").to_pylist())) == [(-s, i) for s, i in want]


def test_top_k_of_large_and_of_equal_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4) * 10.0 ** rng.integers(0, 12)]) for i in range(300)] + [(1000 + i, [0.5] * 4) for i in range(60)] + [(1000, [0.5] * 4)] * 3
    got = vafile.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    clipped = lambda s: max(-(2**63), min(2**63 - 1, s))
    exact = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    for i in {i for i, _ in rows if i % 100 == 0}:
        q = next(v for j, v in exact if j == i)
        want = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in exact if j != i)[:10]
        assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == [(clipped(-s), j) for s, j in want]
    huge = [(0, [-1e300, 1e160, 0.0, 1.0]), (7, [1e307, 0.0, 0.0, 0.0]), (8, [1.0, 2.0, 3.0, 4.0])]
    assert [r.vec_id for r in vafile.search(spark.createDataFrame(huge, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()] == [8, 7]
