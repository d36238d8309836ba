"""Gates, duplicates, budgets, chunks, tokens, decoding and state on literal rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sievewright.functions.constants import Thresholds
from sievewright.functions.frames import running_sum
from sievewright.operators import decoding, dedup, gates, pack, select, tokens
from sievewright.plans import build, runs
from sievewright.sources import chunks, state
from sievewright.streaming import filtering

PROSE = "the quick brown fox jumps, over a lazy dog. "


def judged(spark, texts, limits=Thresholds(min_words=5)):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r.reason for r in gates.with_reason(gates.arrived(rows), "text", limits).collect()}


def test_gates_in_order(spark):
    texts = [
        "<b>" * 50 + " x", "few, words", "☃ " * 40 + "a, b", "a b c d e f !!!!!", "all rights reserved. x y z", "situs slot gacor a b c d e f, g " + PROSE * 20,
        "www.a.xyz " + PROSE * 9, " ".join(f"www.a{i}.com" for i in range(11)) + PROSE * 20, "x " * 12 + "a. b c", "a b c d e f g", "anjing " + PROSE * 3, "download " + PROSE * 3,
        PROSE * 3, None, "   ",
    ]
    got = judged(spark, texts)
    want = ["html_css_spam", "panjang_invalid", "symbol_spam", "symbol_spam", "boilerplate", "gambling_adult_content", "suspicious_domain", "excessive_links", "dominant_repeated_word", "no_punctuation", "profanity", "marketing_spam", None]
    assert [got[k] for k in range(13)] == want
    assert 13 not in got and 14 not in got


def test_word_bounds(spark):
    texts = [" ".join(f"w{i}." for i in range(n)) for n in (499, 500, 10_000, 10_001)]
    got = judged(spark, texts, Thresholds())
    assert [got[k] for k in range(4)] == ["panjang_invalid", None, None, "panjang_invalid"]


def test_language_column(spark):
    rows = spark.createDataFrame([(0, PROSE * 3, "de"), (1, PROSE * 3, "id"), (2, PROSE * 3, None)], "doc_id bigint, text string, lang string")
    got = gates.with_reason(rows, "text", Thresholds(min_words=5, language="column")).orderBy("doc_id").collect()
    assert [r.reason for r in got] == ["bahasa_tidak_diizinkan", None, None]


def test_reports(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "reason string")
    assert [tuple(r) for r in gates.histogram(rows).collect()] == [("b", 2), ("a", 1)]
    assert tuple(gates.funnel(rows, rows).first()) == (4, 1, 3, 25.0)


def test_greedy_is_sequential(spark):
    random.seed(4)
    for n in (1, 3, 40, 120):
        sigs = [[random.random() for _ in range(32)] for _ in range(max(1, n // 8))]
        rows = []
        for _ in range(n):
            s = list(random.choice(rows or sigs) if random.random() < 0.8 else random.choice(sigs))
            for _ in range(random.randint(0, 4)):
                s[random.randrange(32)] = random.random()
            rows.append(s)
        kept = []
        for k, s in enumerate(rows):
            if not any(sum(x == y for x, y in zip(s, rows[j])) >= 28 for j in kept):
                kept.append(k)
        given = spark.createDataFrame([(k, [str(x) for x in s]) for k, s in enumerate(rows)], "id bigint, signature array<string>")
        gone = {r.id for r in dedup.overtaken(given.select("id", dedup.slots("signature").alias("slots"))).collect()}
        assert sorted(set(range(n)) - gone) == kept
        ahead = given.filter(F.col("id").isin(kept[: len(kept) // 2])).select("id", dedup.slots("signature").alias("slots"))
        near = {r.id for r in dedup.near_to(ahead, given.select("id", dedup.slots("signature").alias("slots"))).collect()}
        assert near == {k for k, s in enumerate(rows) if any(sum(x == y for x, y in zip(s, rows[j])) >= 28 for j in kept[: len(kept) // 2])}


def test_rows_that_share_a_band_take_few_rounds(spark, monkeypatch):
    """2,000 rows with one band in common and nothing else, and a chain: rounds follow the chain, not the bucket."""
    rng, rounds = random.Random(7), []
    rows = [[1] * 6 + [rng.getrandbits(60) for _ in range(26)] for _ in range(2000)]
    given = spark.createDataFrame(list(enumerate(rows)), "id bigint, slots array<bigint>")
    cutting = dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: rounds.append(df.columns == ["id", "bucket"]) or cutting(df))
    assert dedup.overtaken(given).count() == 0
    assert sum(rounds) <= 1 + 2 * 3  # what is open at first, and leaders and what is open in each round
    near = [[*rows[0][:k], *(5 + k + i for i in range(4)), *rows[0][k + 4 :]] for k in range(28)]
    mixed = rows[:1500] + [r for r in near for _ in range(3)]
    want, kept = set(), []
    for k, r in enumerate(mixed):
        near_one = any(sum(x == y for x, y in zip(r, mixed[j])) >= 28 for j in kept if j == 0 or j >= 1500)
        (want.add if near_one else kept.append)(k)
    got = dedup.overtaken(spark.createDataFrame(list(enumerate(mixed)), "id bigint, slots array<bigint>"))
    assert {r.id for r in got.collect()} == want


def test_tiles_of_crowded_buckets(spark):
    """Pairs of a bucket of many chunks are found once each, whatever bands they share."""
    rng = random.Random(3)
    base = [str(rng.getrandbits(40)) for _ in range(32)]
    rows = []
    for k in range(60):
        s = list(base)
        for _ in range(rng.randint(0, 5)):
            s[rng.randrange(32)] = str(rng.getrandbits(40))
        rows.append((k, s))
    want = sorted((a, b, n) for a, s in rows for b, t in rows if a < b and (n := sum(x == y for x, y in zip(s, t))) >= 28)
    signed = spark.createDataFrame(rows, "doc_id bigint, signature array<string>")
    for run in (4, 1024):
        assert sorted(tuple(r) for r in dedup.near_pairs(signed, run=run).collect()) == want


def test_bands_miss_nothing():
    assert [n for _, n in dedup.bands()] == [6, 6, 7, 6, 7]
    random.seed(1)
    for _ in range(500):
        off = set(random.sample(range(32), 4))
        assert any(not off & set(range(s, s + n)) for s, n in dedup.bands())


def test_agreement_bar(spark):
    sigs = [(0, [str(i) for i in range(32)]), (1, [str(i) if i < 28 else "x" for i in range(32)]), (2, [str(i) if i < 27 else "y" for i in range(32)])]
    got = dedup.near_pairs(spark.createDataFrame(sigs, "doc_id bigint, signature array<string>")).collect()
    assert [(r.a, r.b, r.agree) for r in got] == [(0, 1, 28)]


def test_pairs_and_members_lose_no_link(spark):
    """One word changed in the middle of a long text may leave all slots equal; such texts are linked by membership."""
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(words), *(" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(20, 280, 20)), "something else entirely"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = docs.select("doc_id", dedup.signature("text").alias("signature")).localCheckpoint()
    of = {r.doc_id: r.signature for r in signed.collect()}
    want = {(a, b) for a in of for b in of if a < b and sum(x == y for x, y in zip(of[a], of[b])) >= 28}
    assert any(of[a] == of[b] for a, b in want)
    first = {r.doc_id: r.representative for r in dedup.members(signed).collect()}
    assert set(first) == set(of)
    near = {(r.a, r.b) for r in dedup.near_pairs(signed.groupBy("signature").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "doc_id")).collect()}
    assert {(a, b) for a in of for b in of if a < b and (first[a] == first[b] or (min(first[a], first[b]), max(first[a], first[b])) in near)} == want


def test_tuple_texts(spark):
    texts = ["it's a 'b\" c\\d e f", "one", ""]
    got = [spark.createDataFrame([(t,)], "t string").select(dedup._shingle_texts("t", 5).alias("s")).first().s for t in texts]
    for t, s in zip(texts, got):
        w = t.split()
        want = {repr(tuple(w[i : i + 5])) for i in range(len(w) - 4)} if len(w) >= 5 else {repr(tuple(w))}
        assert set(s) == want


def test_duplicates(spark):
    long = " ".join(f"word{i}" for i in range(400))
    near = long.replace("word7 ", "other ")
    texts = [long, near, near, long.upper() + " ", "something else entirely, quite short"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, t string")
    got = {r.doc_id: r.dup_reason for r in dedup.deduplicate(rows, "t").collect()}
    assert got == {0: None, 1: "near_duplicate", 2: "exact_duplicate", 3: "exact_duplicate", 4: None}
    capped = {r.doc_id: r.near_duplicate for r in dedup.near_duplicates(rows.filter("doc_id in (0, 1, 4)"), "t", most=1).collect()}
    assert capped == {0: False, 1: True, 4: False}


def test_running_sums(spark):
    rows = spark.createDataFrame([(k % 3 or None, k, k * 7 % 5) for k in range(60)], "g int, k int, v int")
    got = running_sum(rows, "before", F.col("v"), ["g"], F.floor(F.col("k") / 8), ["k"]).collect()
    assert len(got) == 60
    for r in got:
        assert r.before == sum(k * 7 % 5 for k in range(r.k) if (k % 3 or None) == r.g)


def test_buffers_and_budgets(spark):
    rows = spark.createDataFrame([("s", 0, 1.0, 4), ("s", 1, 5.0, 4), ("s", 2, 9.0, 4), ("s", 3, 7.0, 4)], "source string, seq bigint, score double, n bigint")
    out = select.emitted(rows, "score", "n", 2)
    ordered = out.orderBy("before").collect()
    assert [r.score for r in ordered] == [5.0, 1.0, 9.0, 7.0]
    assert [r.score for r in select.within_budget(out, F.lit(5)).orderBy("before").collect()] == [5.0, 1.0]


def put_together(parts):
    out = {}
    for r in sorted(parts.collect(), key=lambda r: (r.chunk_id, r.offset)):
        assert r.offset == len(out.setdefault(r.chunk_id, []))
        out[r.chunk_id] += r.tokens
    return out


def test_chunks(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, [1, 2, 3]), (0, 3, [4, 5, 6, 7]), (0, 7, [8, 9]), (1, 0, [70000 - 5000]), (1, 1, [])], "source_rank int, before bigint, tokens array<int>")
    made = pack.chunk_parts(rows, 4)
    want = {0: [1, 2, 3, 4], 1: [5, 6, 7, 8], 2: [9], 3: [65000]}
    assert put_together(made) == want
    for part in (1, 3, 1 << 16):
        chunks.write(made, str(tmp_path / str(part)), 2, part)
        assert put_together(chunks.read(spark, str(tmp_path / str(part)), part)) == want
    assert sorted(os.listdir(tmp_path / "3" / "shard_001")) == ["chunk_0002.bin", "chunk_0003.bin"]
    sizes = [(0, 4), (1, 4), (2, 1), (3, 1)]
    assert [(r.chunk_id, r.n_tokens) for r in chunks.files(spark, str(tmp_path / "3")).orderBy("chunk_id").collect()] == sizes
    assert sorted(tuple(r) for r in pack.chunk_sizes(made).collect()) == sizes
    raw = spark.read.format("binaryFile").load(str(tmp_path / "3" / "shard_000" / "chunk_0001.bin"))
    assert raw.select(chunks.unpacked(F.col("content")).alias("t")).first().t == [5, 6, 7, 8]
    ids = pack.chunk_sizes(made)
    assert [r.validation for r in pack.split_validation(ids, 2).orderBy("chunk_id").collect()] == [False, False, True, True]
    assert not any(r.validation for r in pack.split_validation(ids, 0).collect())
    assert ids.orderBy("chunk_id").select(pack.chunk_name().alias("n")).first().n == "shard_000/chunk_0000.bin"
    for fault, rows in (("16 bits", [(0, 0, [1, 1 << 16])]), ("goes on", [(0, 0, [1, 2]), (0, 3, [4])])):
        with pytest.raises(Exception, match=fault):
            chunks.write(spark.createDataFrame(rows, "chunk_id bigint, offset bigint, tokens array<int>"), str(tmp_path / "bad"))
    assert not [f for _, _, names in os.walk(tmp_path / "bad") for f in names]


def test_a_chunk_is_written_a_part_at_a_time(spark, tmp_path):
    """The writer's memory is that of a batch of parts, not of a chunk of 8 million tokens."""
    import resource

    parts = spark.range(0, 4000, 1, 4).select(F.lit(0).cast("bigint").alias("chunk_id"), (F.col("id") * 2000).alias("offset"), F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda k: ((F.col("id") + k) % 65536).cast("int")).alias("tokens"))
    chunks.write(parts, str(tmp_path / "big"))
    size = (tmp_path / "big" / "chunk_0000.bin").stat().st_size
    assert size == 16_000_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss > 0
    last = chunks.read(spark, str(tmp_path / "big"), 1 << 20).orderBy(F.desc("offset")).first()
    assert last.tokens[-3:] == [(3999 + k) % 65536 for k in (1997, 1998, 1999)]


def test_windows(spark):
    tokens_of = {0: list(range(50)), 1: [1, 2], 2: list(range(100, 400))}
    parts = [(c, a, t[a : a + 7]) for c, t in tokens_of.items() for a in range(0, len(t), 7)]
    made = spark.createDataFrame(parts, "chunk_id bigint, offset bigint, tokens array<int>")
    sizes = pack.chunk_sizes(made)
    for by_size in (False, True):
        draws = pack.draw_windows(sizes, 40, 8, 3, by_size)
        got = pack.windows(made, draws, 8).collect()
        assert len(got) == 40 and {r.chunk_id for r in got} == {0, 2}
        assert all((r.x, r.y) == (tokens_of[r.chunk_id][r.start : r.start + 8], tokens_of[r.chunk_id][r.start + 1 : r.start + 9]) for r in got)


def test_other_formats(spark, tmp_path):
    from sievewright.sources import readers

    rows = spark.createDataFrame([(f"text {i}, \"quoted\"",) for i in range(20)] + [(None,)], "content string").coalesce(1)
    for kind in ("json", "csv", "orc"):
        writer = rows.write.option("header", True).option("escape", '"') if kind == "csv" else rows.write
        writer.format(kind).save(str(tmp_path / kind))
        got = sorted(readers.load(spark, str(tmp_path / kind), "s", 1, "content", kind).collect(), key=lambda r: r.seq)
        assert [r.seq for r in got] == list(range(len(got)))
        assert [r.text for r in got if r.text is not None] == [f"text {i}, \"quoted\"" for i in range(20)], kind
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    assert [r.text for r in sorted(readers.load(spark, str(tmp_path / "t.txt"), "s", 0, kind="text").collect(), key=lambda r: r.seq)] == ["one", "two"]
    assert {r.text for r in readers.load(spark, str(tmp_path / "json"), "s", 1, "nowhere", "json").collect()} == {None}


def test_detector_votes(spark):
    """Half of the votes is enough; texts without samples pass; nulls are no votes."""
    word = lambda w, n: (w + " ") * n
    texts = [word("deer, owl", 400), word("fox, hen", 400), word("deer, owl", 60), word("fox, hen", 400) + word("deer, owl", 200), word("cat, dog", 300), None]
    seen = []

    def detect(samples):
        seen.extend(samples)
        return ["de" if "deer" in s and "fox" not in s else "en" if "fox" in s else None for s in samples]

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    limits = Thresholds(min_words=5, language="detect", max_symbol_ratio=1.0, max_boilerplate=1e9, dominant_min_words=10**9)
    got = {r.doc_id: r.reason for r in gates.with_reason(gates.arrived(rows), "text", limits, detect).collect()}
    assert got == {0: "bahasa_tidak_diizinkan", 1: None, 2: None, 3: None, 4: None}
    with pytest.raises(ValueError):
        gates.with_reason(rows, "text", limits)
    with pytest.raises(ValueError):
        gates.with_reason(rows, "text", Thresholds(), detect)


def test_signatures_of_workers_as_the_expression(spark):
    texts = ["", "one", "a b", "it's a 'b\" c\\d e f g", "É ü " * 30, "word " * 9, " ".join(f"w{i}" for i in range(700)), "x" * 300 + " y z a b c", None]
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, other string")
    made = dedup.signed(rows)
    assert made.columns == ["doc_id", "other", "signature"]
    want = {r.doc_id: r.s for r in rows.select("doc_id", dedup.signature(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    assert {r.doc_id: r.signature for r in made.collect()} == want
    assert len({len(r.signature) for r in dedup.signed(rows, fast=True).collect()}) == 1
    assert dedup.signed(rows.limit(0)).count() == 0


def test_golden_strings(spark, tmp_path):
    """Round trips of the kinds of text that the reference tries its tokenizer on."""
    lines = ["Indonesia adalah negara kepulauan terbesar di dunia.", "The quick brown fox jumps over the lazy dog.", "def f(n):\n    return n if n < 2 else f(n - 1)", "<pengguna>Apa ibu kota Indonesia?</pengguna><asisten>"]
    model = tokens.train(spark.createDataFrame([(t,) for t in lines * 20], "text string"), vocab=400)
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in tokens.pieces(tokens.safe_decode(tokens.encode(rows, model), model), model).collect()}
    assert [" ".join(got[k].decoded.split()) for k in range(4)] == [" ".join(t.split()) for t in lines]
    assert [p for p in got[3].pieces if p.startswith("<") and p.endswith(">")] == ["<pengguna>", "</pengguna>", "<asisten>"]


@pytest.fixture(scope="module")
def model(spark):
    lines = spark.createDataFrame([(PROSE * 3 + f" number {i}",) for i in range(200)], "text string")
    return tokens.train(lines, vocab=330)


def test_tokens(spark, model):
    rows = spark.createDataFrame([(0, "the quick fox"), (1, None), (2, "snow ☃ man")], "doc_id bigint, text string")
    coded = tokens.pieces(tokens.safe_decode(tokens.encode(rows, model), model), model)
    got = {r.doc_id: r for r in coded.collect()}
    assert got[0].decoded == "the quick fox" and got[1].tokens == [] and got[2].decoded.replace(" ", "") == "snow☃man"
    broken = spark.createDataFrame([([3 + 4 + 0xF0 + 1, 3 + 4 + 0x9F + 1] + got[0].tokens,)], "tokens array<int>")
    names = tokens.pieces(broken, model).first().pieces
    assert names[0] == "<0xF0>" and tokens.safe_decode(broken, model).first().decoded == "the quick fox"


def test_decoding(spark):
    rows = spark.createDataFrame([(0, t, x) for t, x in enumerate([2.0, 1.0, 1.0, -1.0])], "step int, token_id int, logit double")
    assert sorted(r.token_id for r in decoding.top_k(rows, 2).collect()) == [0, 1, 2]
    seen = spark.createDataFrame([(0, 0), (0, 0), (0, 3)], "step int, token_id int")
    assert [r.logit for r in decoding.penalised(rows, seen, 2.0).orderBy("token_id").collect()] == [0.5, 1.0, 1.0, -2.0]
    runs_ = spark.createDataFrame([(0, [1, 2, 3, 1, 2]), (1, [5]), (2, [7, 7])], "step int, tokens array<int>")
    assert sorted(tuple(r) for r in decoding.banned_tokens(runs_, 3).collect()) == [(0, 3)]
    assert sorted(tuple(r) for r in decoding.banned_tokens(runs_, 2).collect()) == [(0, 3), (2, 7)]
    chances = decoding.probabilities(rows)
    assert chances.agg(F.sum("probability")).first()[0] == pytest.approx(1)
    assert decoding.draw(chances, 1).collect() == decoding.draw(chances, 1).collect()


def test_runs(spark, tmp_path):
    sizes = {r["name"]: r.parameters for r in runs.presets(spark).collect()}
    assert [round(v / 1e6, 1) for v in sizes.values()] == [125.3, 303.4, 489.9, 1054.7]
    assert runs.preset(spark, "prod_1b").count() == 1
    with pytest.raises(ValueError):
        runs.preset(spark, "none")
    with pytest.raises(Exception, match="multiple of heads"):
        runs.checked(spark.createDataFrame([(10, 3, 1)], "hidden int, heads int, kv_heads int")).collect()
    rates = [r.rate for r in runs.learning_rates(spark, 1.0, 0.1, 4, 10).collect()]
    assert rates[:4] == [0.25, 0.5, 0.75, 1.0] and rates[4] == 1.0 and rates[-1] > 0.1
    listing = spark.createDataFrame([("step_1", 1.0), ("step_2", 2.0), ("step_3", 3.0), ("step_4", 4.0), ("step_5_final", 0.0)], "name string, mtime double")
    assert sorted(r["name"] for r in runs.expired(listing).collect()) == ["step_1", "step_2"]
    assert runs.expired(listing, 0).count() == 0
    log = spark.createDataFrame([(1, 3.12345678, None), (2, 2.0, 2.5)], "step bigint, train double, val double")
    runs.append_losses(log, str(tmp_path / "log"))
    (tmp_path / "log" / "bad.json").write_text("{not json")
    runs.append_losses(log.filter("step > 9"), str(tmp_path / "log"))
    got = runs.read_losses(spark, str(tmp_path / "log"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3.123457, None), (2, 2.0, 2.5)]
    assert runs.mean_loss(log).first().train == pytest.approx(2.56172839)


def test_progress(spark, tmp_path):
    path = str(tmp_path / "progress.json")
    assert state.load_progress(spark, path) == state.Progress()
    (tmp_path / "progress.json").write_text('{"completed_sources": ["a"], "chunk_idx": 3, "total_tokens": 9}')
    old = state.load_progress(spark, path)
    assert old.completed_sources == ["a"] and old.tokens_per_source == {}
    old.tokens_per_source["b"] = 5
    state.save_progress(spark, path, old)
    assert state.load_progress(spark, path) == old
    assert state.progress_frame(spark, old).first().tokens_per_source == {"b": 5}
    assert state.catalog(spark).agg(F.sum("target")).first()[0] == 100_000_000_000


def prose(k, n=60):
    return " ".join(f"w{k}x{i}," for i in range(n)) + "."


def test_build(spark, model, tmp_path):
    a = [(i, prose(i)) for i in range(6)] + [(6, prose(2)), (7, "short")]
    b = [(0, prose(1)), (1, prose(90)), (2, prose(3) + " zz.")]
    docs = {n: spark.createDataFrame(r, "seq bigint, text string") for n, r in (("a", a), ("b", b))}
    settings = build.Settings(Thresholds(min_words=5, max_symbol_ratio=1.0), buffer=2, chunk=500, shard=2)
    out = str(tmp_path)
    done = build.build(spark, docs, {"a": 10**9, "b": 10**9}, model, out, settings)
    assert done.completed_sources == ["a", "b"] and done.total_tokens == sum(done.tokens_per_source.values())
    sizes = chunks.files(spark, out).agg(F.sum("n_tokens"), F.count("*")).first()
    assert sizes[0] == done.total_tokens and sizes[1] == done.chunk_idx
    kept = spark.read.parquet(*[f"{out}/state/signatures/{x}" for x in done.batches])
    assert kept.count() == 7
    assert build.build(spark, docs, {"a": 10**9, "b": 10**9}, model, out, settings) == done


def test_budget_ends_what_is_seen(spark):
    rows = spark.createDataFrame([(i, prose(i)) for i in range(8)], "seq bigint, text string")
    count = lambda d: d.withColumn("tokens", F.array(F.lit(1))).withColumn("n_tokens", F.lit(10).cast("bigint"))
    none = spark.createDataFrame([], build.EXACT), spark.createDataFrame([], build.SIGNATURES)
    got = build.select_source(rows, *none, 25, count, build.Settings(Thresholds(min_words=5, max_symbol_ratio=1.0), buffer=2))
    assert got.emitted.count() == 3
    assert got.exact.count() == 4 and got.signatures.count() == 4


def test_stream(spark, tmp_path):
    schema = "seq bigint, text string"
    for k, rows in enumerate([[(0, prose(0)), (1, prose(1)), (2, "no")], [(3, prose(0)), (4, prose(4))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        filtering.run_available(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check"), Thresholds(min_words=5, max_symbol_ratio=1.0))
        del k
    kept = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out" / "kept"))
    gone = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out" / "rejected"))
    assert sorted(r.seq for r in kept.collect()) == [0, 1, 4]
    assert {(r.seq, r.reason) for r in gone.collect()} == {(2, "panjang_invalid"), (3, "exact_duplicate")}


def test_command_line(spark, model, tmp_path, capsys):
    from sievewright.__main__ import main

    for name, rows in (("wikipedia_en", [prose(i) for i in range(5)]), ("wikipedia_id", [prose(2), prose(7), None])):
        spark.createDataFrame([(t,) for t in rows], "text string").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    (tmp_path / "m.model").write_bytes(model)
    flags = ["--tokenizer", str(tmp_path / "m.model"), "--min-words", "5", "--chunk-size", "700"]
    main(["build", str(tmp_path / "in"), str(tmp_path / "out"), *flags, "--sources", "wikipedia_id", "wikipedia_en"])
    assert "complete: wikipedia_id, wikipedia_en; failed: none" in capsys.readouterr().out
    n, following = chunks.resume_point(spark, str(tmp_path / "out"))
    assert n > 0 and following == chunks.files(spark, str(tmp_path / "out")).count()
    main(["filter", str(tmp_path / "in" / "wikipedia_en"), str(tmp_path / "one"), *flags, "--target-tokens", "1", "--fast-signatures"])
    assert "complete: source" in capsys.readouterr().out
    main(["chunks", str(tmp_path / "one")])
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == chunks.files(spark, str(tmp_path / "one")).count() and lines[-1].endswith("validation")


def test_numbered_rows(spark, tmp_path):
    from sievewright.sources import readers

    spark.createDataFrame([(i, f"t{i}") for i in range(40)], "n int, content string").repartition(3).write.parquet(str(tmp_path / "p"))
    got = readers.load(spark, str(tmp_path / "p"), "s", 2, "content").collect()
    assert sorted(r.seq for r in got) == list(range(40)) and {r.source_rank for r in got} == {2}
    assert [r.text for r in sorted(got, key=lambda r: r.seq)] == [r.content for r in spark.read.parquet(str(tmp_path / "p")).select("content", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()]
    assert {r.text for r in readers.load(spark, str(tmp_path / "p"), "s", 2, "n").collect()} == {None}
