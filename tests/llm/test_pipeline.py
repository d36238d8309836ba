"""The pipeline's stages, each against a plain statement of what it must do to its input."""

import base64
import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import tiktoken
from test_native import WORDS, brute_targets
from test_similar import components, jaccard, shingles
from test_workers import brute_fingerprint, brute_spans

from sievewright.llm._vocab import PATTERN, locate
from sievewright.llm.queries import BYTE_VOCABULARY

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, position string, root string, ids string"


def rows_of(docs):
    """Literal rows: nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(n)) for n in (60, 200, 20_000)]
    near = [" ".join(w if i != len(b.split()) // 2 else "changed" for i, w in enumerate(b.split())) for b in base]
    texts = [r.text for r in docs.limit(40).collect()] + base + near + [base[0], base[0].upper(), None, None, "", " \n", "one", "x" * 200_000, "mail a.b@c.dd, card 4111 1111 1111 1111. " + base[1]]
    rows = [(i, t, "en", f"src{i % 4}" if i % 7 else None, None if t is None else len(t), 0.5, "p", "r", None) for i, t in enumerate(texts)]
    rows += [rows[41], rows[3], (3, rows[3][1], "de", "src0", None, None, None, None, None), (None, base[1], None, None, None, None, None, None, None), (None, "alone and without a number " * 3, None, "src1", None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What each stage got and gave, as the pipeline passes it on."""
    folder = tmp_path_factory.mktemp("stages")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    docs = spark.createDataFrame(rows_of(given), SCHEMA)
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(folder / "labels.parquet"))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(str(folder / str(k)))
        made = spark.read.parquet(str(folder / str(k)))
        seen.append((docs.collect(), made.collect()))
        assert k == 4 or made.columns == docs.columns
        docs = made
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixture", "bpe"]
    return seen


def test_quality_keeps_rows_as_they_are(staged):
    given, kept = staged[0]
    assert not Counter(map(tuple, kept)) - Counter(map(tuple, given)) and 0 < len(kept) <= len(given)
    texts = Counter(r.text for r in given)
    assert all(n == texts[t] for t, n in Counter(r.text for r in kept).items())


def test_quality_keeps_good_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.good(spark, docs, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([d in kept for d, q in labels.items() if q == 1]) >= 0.95 and np.mean([d in kept for d, q in labels.items() if q == 0]) < 0.2


def test_one_of_each_group_stays(spark):
    """All links of fingerprints and of similarity, compared plainly, over the whole fixture."""
    given = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    out = corpus_pipeline.distinct(spark, spark.createDataFrame(given, SCHEMA), SF)
    prints, sets = [brute_fingerprint(r[1]) for r in given], [shingles(r[1] or "") for r in given]
    joined = [(i, j) for j in range(len(given)) for i in range(j) if bin(prints[i] ^ prints[j]).count("1") <= 2 or jaccard(sets[i], sets[j]) >= 0.8]
    groups = {}
    for row, label in zip(given, components(given, joined)):
        groups.setdefault(label, []).append(row)
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values())
    kept = out.collect()
    assert Counter(r.doc_id for r in kept) == want
    assert all(tuple(r) in given for r in kept)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, kept))


def test_personal_data_goes(staged):
    given, made = staged[2]
    assert len(given) == len(made)
    mended = {(r.doc_id, r.source): r for r in made}
    for r in given:
        after = mended[r.doc_id, r.source]
        found = sorted((s, e, k) for k, s, e in brute_spans(r.text or ""))
        assert brute_spans(after.text or "") == []
        if not found and not re.search("[A-Z]{2}[0-9]{2}|[0-9]{3}-[0-9]{2}-|[0-9A-Fa-f]{2}:", r.text or ""):
            assert tuple(after) == tuple(r)
        for s, e, k in found[:1]:
            assert after.text.startswith(r.text[:s] + f"[{k.upper()}]") and after.n_chars in (None, len(after.text))


def test_mixture_meets_its_targets(staged):
    given, made = staged[3]
    size = lambda r: len(WORDS.findall(r.text or ""))
    sizes, taken, largest = Counter(), Counter(), {}
    for r in given:
        sizes[r.source] += size(r)
        largest[r.source] = max(largest.get(r.source, 0), size(r))
    for r in made:
        taken[r.source] += size(r)
    for source, target in brute_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1
    times = Counter(map(tuple, given))
    assert all(n <= 2 * times[r] for r, n in Counter(map(tuple, made)).items())


def test_tokens_as_the_library(staged):
    given, made = staged[4]
    with open(locate(BYTE_VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(own.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in given)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in made) == want
    assert all(r.n_tokens == len(r.ids) for r in made)
    assert sorted(r.position for r in made) == list(range(len(made)))


def test_positions_follow_the_curriculum(spark, tmp_path):
    """The order of the mixture outlives being written and read: rows of its files, numbered, are in order of position."""
    from sievewright.llm import curriculum

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = [(r.position, r.doc_id) for r in curriculum.mix(docs).collect()]
    corpus_pipeline.mixed(spark, docs, SF).write.parquet(str(tmp_path / "m"))
    got = corpus_pipeline.encoded(spark, spark.read.parquet(str(tmp_path / "m")), SF)
    assert [r.doc_id for r in sorted(got.collect(), key=lambda r: r.position)] == [d for _, d in sorted(order)]
    assert {r.position for r in corpus_pipeline.encoded(spark, spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), SF).collect()} == {None}


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out._jdf.queryExecution().toString().count("MapInArrow") <= 4  # the last stage's alone, once in each form of the plan
    rows = out.collect()
    assert rows and sorted(r.position for r in rows) == list(range(len(rows)))


def test_empty_documents(spark, tmp_path):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
