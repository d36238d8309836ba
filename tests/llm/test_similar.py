"""Near copies by five-word similarity, against every pair compared plainly."""

import random

import corpus_pipeline
import pyarrow as pa
from sievewright.llm import similar


def shingles(text):
    w = text.lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def components(texts, joined):
    label = list(range(len(texts)))
    while True:
        before = list(label)
        for i, j in joined:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            return label


def families(rng):
    """Texts with copies of them in which single words are changed, at similarities on both sides of 0.8."""
    out = []
    for n in (3, 7, 40, 100, 300, 1000):
        for edits in (0.005, 0.01, 0.02, 0.025, 0.04):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            for _ in range(3):
                out.append(" ".join(f"x{rng.randrange(5000)}" if rng.random() < edits else w for w in base))
    rng.shuffle(out)
    return out


def pairs(texts):
    sets = [shingles(t or "") for t in texts]
    return [(i, j) for j in range(len(texts)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]


def test_similar_is_exact():
    texts = families(random.Random(1)) + ["", None, "one two", "One  two"]
    assert similar.similar(pa.array(texts)).tolist() == components(texts, pairs(texts))


def test_links_at_any_chunk(spark):
    texts = families(random.Random(2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = {r.k: r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(text) AS k").collect()}
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    want = components(texts, pairs(texts))
    for run, weight in ((similar.RUN, similar.WEIGHT), (2, 500)):
        found = [(first[texts[key[r.a]]], first[texts[key[r.b]]]) for r in similar.links(docs, run, weight).collect()]
        same = [(first[t], i) for i, t in enumerate(texts)]
        assert components(texts, found + same) == want


def test_stage_leaves_no_near_copies(spark):
    texts = families(random.Random(3)) + ["", None]
    docs = spark.createDataFrame([(i, t, "src0") for i, t in enumerate(texts)] + [(0, texts[0], "src0")], "doc_id long, text string, source string")
    out = corpus_pipeline.distinct(spark, docs, "")
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and len(kept) == len(set(kept))
    assert pairs([texts[k] for k in kept]) == []
    near = pairs(texts)
    for k in set(range(len(texts))) - set(kept):
        assert not (texts[k] or "").strip() or any(k in p for p in near)
