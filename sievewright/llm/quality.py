"""Quality classifier (operator 4).

Words (runs of letters and digits, runs of signs) are hashed to BUCKETS; a few buckets stand for shapes: capitals,
repeats of the word before, signs glued to a word. Random indexing over the whole corpus gives every bucket a vector:
each word has a sparse ternary index vector drawn by its hash, and a bucket sums the index vectors of the words next
to its words; one task adds up one matrix, and matrices are summed by bucket in a partial aggregation. A document is
the frequency-weighted mean of its words' vectors, with its length. A network of two layers in numpy is fitted on the
driver to at most SAMPLE labelled documents, and a temperature, fitted on documents that the layers haven't seen,
calibrates its probabilities.

Labels are read only for rows whose crc32(doc_id as text) mod 3 is not 1. Neither lang, source, doc_id nor n_chars is
an input.

Defined results: a null text is the empty text and has a score, as any; repeated rows score alike; a label that
repeats with another value counts as the lower one; a null doc_id is not held out; without labels of both kinds every
score is the share of label 1 (0.5 without labels); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm._batches import slices
from sievewright.llm._words import LOWER, SPACE, buffer

BUCKETS, DIM, NONZERO = 8192, 32, 4
#: Labelled documents that the network is fitted to, at most.
SAMPLE = 20_000
HIDDEN, ROUNDS, SEED = 32, 400, 7
#: Text that a worker looks at once; its arrays take some 40 bytes for each byte of it.
SLICE = 1 << 20
#: Words of this relative frequency weigh half.
RARE = 1e-3
#: Buckets of shapes: capitals, repeated word, repeated pair, glued signs, long run of signs.
SHAPES = 5

_P = np.uint64(0x9E3779B97F4A7C15)
#: 1 for a sign, 0 for what makes words; blanks apart.
SIGN = np.zeros(256, bool)
SIGN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _P)
    p[:1] = 1
    return np.multiply.accumulate(p)


def word_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, bucket) of every word and shape, in text order within a document; number of documents."""
    raw, starts = buffer(column)
    blank, sign = SPACE[raw], SIGN[raw]
    kind = np.where(blank, 0, np.where(sign, 2, 1)).astype(np.int8)
    edge = np.r_[True, kind[1:] != kind[:-1]]
    heads = np.flatnonzero(edge)
    ends = np.r_[heads[1:], len(raw)]
    real = kind[heads] > 0
    heads, ends, glued = heads[real], ends[real], (kind[np.maximum(heads - 1, 0)] == 1)[real] if len(heads) else np.zeros(0, bool)
    if not len(heads):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), len(starts)
    sizes = ends - heads
    low = LOWER[raw]
    place = np.arange(len(raw)) - np.repeat(np.flatnonzero(edge), np.diff(np.r_[np.flatnonzero(edge), len(raw)]))
    weight = _powers(int(sizes.max()) + 1)
    term = (low.astype(np.uint64) + np.uint64(1)) * weight[np.minimum(place, len(weight) - 1)]
    term[kind == 0] = 0
    h = _mixed(np.add.reduceat(term, heads) + sizes.astype(np.uint64))
    doc = np.searchsorted(starts, heads, side="right") - 1
    bucket = (h % np.uint64(BUCKETS - SHAPES)).astype(np.int64) + SHAPES
    capital = np.add.reduceat((raw != low).astype(np.int64), heads)
    signs = kind[heads] == 2
    same = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]
    pair = np.r_[False, False, (h[2:] == h[:-2]) & (doc[2:] == doc[:-2])][: len(h)]
    shapes = [~signs & (capital >= 2) & (2 * capital > sizes), same, pair, signs & glued & (sizes >= 2), signs & (sizes >= 3)]
    at = [np.arange(len(h)), *(np.flatnonzero(s) for s in shapes)]
    which = [bucket, *(np.full(int(s.sum()), k) for k, s in enumerate(shapes))]
    at = np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return doc[at[order]], np.concatenate(which)[order], len(starts)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of each bucket's index vector."""
    h = _mixed(np.arange(1, BUCKETS * NONZERO + 1, dtype=np.uint64) * _P).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def context_sums(doc: np.ndarray, bucket: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds what the words of some documents see beside them."""
    places, signs = index_vectors()
    counts += np.bincount(bucket, minlength=BUCKETS)
    beside = np.flatnonzero(doc[1:] == doc[:-1])
    for here, there in ((bucket[beside], bucket[beside + 1]), (bucket[beside + 1], bucket[beside])):
        for k in range(NONZERO):
            sums += np.bincount(here * DIM + places[there, k], weights=signs[there, k], minlength=BUCKETS * DIM)


@dataclass
class Words:
    """Vector of each bucket, with the bucket's own index vector, and its weight."""

    vectors: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, sums: np.ndarray) -> Words:
        places, signs = index_vectors()
        own = np.zeros((BUCKETS, DIM))
        np.add.at(own, (np.arange(BUCKETS)[:, None], places), signs)
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        share = counts / max(1.0, counts.sum())
        weights = RARE / (RARE + share)
        weights[:SHAPES] = 1.0
        return cls((unit(sums) + unit(own)).astype(np.float32), weights.astype(np.float32))

    def features(self, column: pa.Array) -> np.ndarray:
        """Mean vector of each document, shares of the shapes, and length."""
        doc, bucket, n = word_stream(column)
        size = np.bincount(doc, minlength=n).astype(np.float64)
        out = np.zeros((n, DIM + SHAPES + 2))
        if len(doc):
            heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            weight = self.weights[bucket]
            total = np.add.reduceat(weight, heads)
            out[doc[heads], :DIM] = np.add.reduceat(self.vectors[bucket] * weight[:, None], heads, axis=0) / np.maximum(total, 1e-9)[:, None]
            low = bucket < SHAPES
            out[:, DIM : DIM + SHAPES] = np.bincount(doc[low] * SHAPES + bucket[low], minlength=n * SHAPES).reshape(n, SHAPES) / np.maximum(size, 1)[:, None]
        out[:, -2] = np.linalg.norm(out[:, :DIM], axis=1)
        out[:, -1] = np.log1p(size)
        return out


@dataclass
class Network:
    """Two layers; probabilities are calibrated by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, tune: np.ndarray) -> Network:
    """tune: rows that set the temperature instead of the layers."""
    rng, d = np.random.default_rng(SEED), x.shape[1]
    share = float(y.mean()) if len(y) else 0.5
    prior = float(np.log(share / (1 - share))) if 0 < share < 1 else (0.0 if not len(y) else 40.0 * (2 * share - 1))
    net = Network(x.mean(axis=0) if len(x) else np.zeros(d), (x.std(axis=0) if len(x) else np.ones(d)) + 1e-6, np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), prior)
    if not len(y) or not 0 < share < 1:
        return net
    learn = ~tune if 0 < y[~tune].sum() < (~tune).sum() else np.ones(len(y), bool)
    z, t = (x[learn] - net.mean) / net.scale, y[learn].astype(np.float64)
    net.w1, net.w2 = rng.normal(0, d**-0.5, (d, HIDDEN)), rng.normal(0, HIDDEN**-0.5, HIDDEN)
    values = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values]
    step = 0
    for _ in range(max(1, ROUNDS * 256 // max(256, len(z))) if len(z) > 25_600 else ROUNDS // max(1, len(z) // 1024)):
        order = rng.permutation(len(z))
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            hidden = np.tanh(z[some] @ values[0] + values[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3][0], -40, 40))) - t[some]) / len(some)
            back = np.outer(error, values[2]) * (1 - hidden**2)
            grads = [z[some].T @ back + 1e-4 * values[0], back.sum(axis=0), hidden.T @ error + 1e-4 * values[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                values[k] -= 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    if tune.any():
        logit, t = net.logits(x[tune]), y[tune]
        loss = lambda s: np.logaddexp(0, np.where(t == 1, -logit, logit) / s).mean()
        net.temperature = float(min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss))
    return net


def remainder(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3))


def learn_words(docs: DataFrame) -> Words:
    """Over every row. The driver gets BUCKETS rows, whatever the input."""
    names = ["n", *(f"v{k}" for k in range(DIM))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                doc, bucket, _ = word_stream(part.column("text"))
                if len(doc):
                    context_sums(doc, bucket, sums, counts)
        used = np.flatnonzero(counts)
        rows = np.c_[counts, sums.reshape(BUCKETS, DIM)][used]
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(rows[:, k]) for k in range(DIM + 1))], names=["bucket", *names])

    parts = docs.select("text").mapInArrow(run, "bucket bigint, " + ", ".join(f"{n} double" for n in names))
    found = np.array([tuple(r) for r in parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).collect()]).reshape(-1, DIM + 2)
    full = np.zeros((BUCKETS, DIM + 1))
    full[found[:, 0].astype(int)] = found[:, 1:]
    return Words.of(full[:, 0], full[:, 1:])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Words, Network]:
    words = learn_words(docs)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    known = labels.filter((remainder() != 1) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                x = shared.value.features(part.column("text"))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "y": part.column("y"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y"))
    firsts = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    got = sorted((int(r.doc_id), r.y, r.x) for r in firsts.collect())
    x, y = np.array([r[2] for r in got]).reshape(len(got), DIM + SHAPES + 2), np.array([min(1, max(0, r[1])) for r in got], np.int64)
    tune = (_mixed(np.array([r[0] for r in got], np.int64).view(np.uint64)) % np.uint64(5) == 0) if got else np.zeros(0, bool)
    return words, fit(x, y, tune)


def score(docs: DataFrame, model: tuple[Words, Network]) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = shared.value
        for batch in batches:
            for part in slices(batch, most=SLICE):
                p = net.probabilities(words.features(part.column("text")))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")
    return scored.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: tuple[Words, Network], least: float = 0.5) -> DataFrame:
    """The rows that score at least so much, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = shared.value
        for batch in batches:
            for part in slices(batch, most=SLICE):
                yield part.filter(pa.array(net.probabilities(words.features(part.column("text"))) >= least))

    return docs.mapInArrow(run, docs.schema)
