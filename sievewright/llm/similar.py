"""Near copies by five-word similarity: which texts share at least SIMILAR of their runs of five words (Jaccard).

The pipeline's stage. SimHash within two bits (operator 3) sees few of these pairs, so they have a search of their own:

1. Each text gets SLOTS minimum hashes over its distinct runs of SHINGLE words; two texts meet under each band of ROWS
   equal slots. A pair at similarity 0.8 meets nowhere with probability (1 - 0.8 ** 4) ** 24, about 3 in a million; a
   pair above it less often. Pairs that meet but agree in fewer than MAYBE slots are let go: at 0.8 the slots agree 77
   times on average and fewer than 57 times about once in two million.
2. What is left is joined into trees of candidates, and inside a tree every two texts are compared by their whole sets
   of runs, exactly, unless links already join them.

A crowded band and a heavy tree are dealt out in chunks, every two of which meet in a task of their own. Words are cut
at ASCII white space and lowered in ASCII, as in operator 3; fewer than five words are one run; no words, no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm import simhash
from sievewright.llm._batches import cut, slices

SHINGLE, SEED, SIMILAR = 5, 43, 0.8
ROWS, BANDS = 4, 24
SLOTS, MAYBE = ROWS * BANDS, 57
#: Texts under one band, and runs of words in one tree of candidates, that one chunk holds.
RUN, WEIGHT = 1024, 1 << 17

_DRAW = np.random.default_rng(SEED)
_FLIP, _TIMES = _DRAW.integers(0, 2**63, SLOTS, np.uint64), _DRAW.integers(0, 2**63, SLOTS, np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, weights, slots) of the texts that have words: runs of words, and minimum hashes as rows of uint64."""
    per, h = simhash.shingle_hashes(column, SHINGLE, SEED)
    heads = np.flatnonzero(np.r_[True, per[1:] != per[:-1]]) if len(per) else np.zeros(0, np.int64)
    slots = np.empty((len(heads), SLOTS), np.uint64)
    for k in range(SLOTS if len(heads) else 0):
        mixed = (h ^ _FLIP[k]) * _TIMES[k]
        mixed ^= mixed >> np.uint64(32)
        slots[:, k] = np.minimum.reduceat(mixed * _TIMES[k - 1], heads)
    return per[heads], np.diff(np.r_[heads, len(per)]), slots


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            at, weight, slots = sketches(part.column("text"))
            mixed = slots.reshape(len(at), BANDS, ROWS)
            keys = np.zeros((len(at), BANDS), np.uint64)
            for k in range(ROWS):
                keys = (keys ^ mixed[:, :, k]) * _TIMES[k]
                keys ^= keys >> np.uint64(29)
            keys = (keys ^ np.arange(BANDS, dtype=np.uint64)) * _TIMES[ROWS]
            edge = pa.array(np.arange(len(at) + 1, dtype=np.int32) * BANDS)
            low = np.ascontiguousarray((slots & np.uint64(255)).astype(np.uint8))
            yield pa.RecordBatch.from_pydict(
                {
                    "node": part.column("text_key").take(pa.array(at)),
                    "weight": pa.array(weight, pa.int64()),
                    "bands": pa.ListArray.from_arrays(edge, pa.array(keys.ravel().view(np.int64))),
                    "slots": pa.array([r.tobytes() for r in low], pa.binary()),
                }
            )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(run, rows) with the rows of each run together; runs come one after the other."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        run = rows.column("run").to_numpy()
        start = len(run) - int(np.argmax(run[::-1] != run[-1])) if (run != run[-1]).any() else 0
        held = rows.slice(start)
        if start:
            yield run[:start], rows.slice(0, start)
    if held is not None:
        yield held.column("run").to_numpy(), held


def forest(n: int, near) -> np.ndarray:
    """For each of n the least of its tree; near(i, others): which of the others link to i. Pairs of one tree are skipped."""
    label = np.arange(n)
    for i in range(n - 1):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if len(others):
            met = np.unique(np.r_[label[others[near(i, others)]], label[i]])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    return label


def _edges(node: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    linked = label != np.arange(len(node))
    return pa.RecordBatch.from_pydict({"a": pa.array(node[linked]), "b": pa.array(node[label[linked]])})


def _maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run, rows in _whole(batches):
        node = rows.column("node").to_numpy()
        slots = np.frombuffer(b"".join(rows.column("slots").to_pylist()), np.uint8).reshape(-1, SLOTS)
        heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        ends = np.r_[heads[1:], len(run)]
        first = np.repeat(heads, ends - heads)
        label = np.where((slots == slots[first]).sum(1) >= MAYBE, first, np.arange(len(run)))
        apart = np.add.reduceat((label != first).astype(np.int64), heads)
        for a, b in zip(heads[apart > 0].tolist(), ends[apart > 0].tolist(), strict=True):
            own = slots[a:b]
            label[a:b] = a + forest(b - a, lambda i, others: (own[others] == own[i]).sum(1) >= MAYBE)  # noqa: B023
        yield _edges(node, label)


def similar(texts: pa.Array) -> np.ndarray:
    """For each text the least of its tree of links at SIMILAR or more, by exact Jaccard over distinct runs of words."""
    per, h = simhash.shingle_hashes(texts, SHINGLE, SEED)
    known, number = np.unique(h, return_inverse=True)
    pairs = np.unique(per * max(len(known), 1) + number)
    owner, item = pairs // max(len(known), 1), pairs % max(len(known), 1)
    size = np.bincount(owner, minlength=len(texts))
    edge = np.r_[0, np.cumsum(size)]
    mark = np.zeros(len(known), bool)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        fit = np.flatnonzero((np.minimum(size[others], size[i]) * 5 >= np.maximum(size[others], size[i]) * 4) & (size[others] > 0))
        if len(fit):
            mine = item[edge[i] : edge[i + 1]]
            mark[mine] = True
            low, high = int(others[fit[0]]), int(others[fit[-1]]) + 1
            sums = np.r_[0, np.cumsum(mark[item[edge[low] : edge[high]]])]
            both = sums[edge[others[fit] + 1] - edge[low]] - sums[edge[others[fit]] - edge[low]]
            mark[mine] = False
            out[fit] = both * 5 >= (size[i] + size[others[fit]] - both) * 4  # SIMILAR in whole numbers
        return out

    return forest(len(texts), near)


def _sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run, rows in _whole(batches):
        node, texts = rows.column("node").to_numpy(), rows.column("text").combine_chunks()
        heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        for a, b in zip(heads.tolist(), np.r_[heads[1:], len(run)].tolist(), strict=True):
            yield _edges(node[a:b], similar(texts.slice(a, b - a)))


def _meeting(key: str, chunks: Column) -> Column:
    """The runs of a row: one for a key of one chunk, else one for each chunk that its own chunk meets."""
    own = F.pmod(F.xxhash64("node"), chunks)
    pair = lambda c: F.xxhash64(key, F.least(c, own), F.greatest(c, own))
    return F.when(chunks == 1, F.array(F.xxhash64(key))).otherwise(F.transform(F.sequence(F.lit(0), chunks - 1), pair))


def _placed(docs: DataFrame) -> DataFrame:
    """Adds plain columns that tell a row by its doc_id, which may be null, and its text."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.withColumns({"__sw_null": F.col("doc_id").isNull(), "__sw_id": F.coalesce("doc_id", F.lit("0").cast(kind)), "__sw_text": F.xxhash64("text")})


_PLACE = ["__sw_null", "__sw_id", "__sw_text"]


def candidates(sketched: DataFrame, run: int = RUN) -> DataFrame:
    """(node, tree): texts of one tree that may be near copies; sketched: node, weight, bands, slots, nodes distinct."""
    keyed = sketched.select("node", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    meets = _meeting("key", F.ceil(F.col("n") / run))
    dealt = cut(keyed.join(crowded, "key").select("node", F.explode(meets).alias("run")))
    full = dealt.join(sketched.select("node", "slots"), "node").repartition("run").sortWithinPartitions("run", "node")
    edges = full.mapInArrow(_maybe, "a bigint, b bigint")
    found = cut(simhash.components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    return found.select("node", F.col("root").alias("tree")).union(found.select(F.col("root").alias("node"), F.col("root").alias("tree")).distinct())


def links(docs: DataFrame, run: int = RUN, weight: int = WEIGHT) -> DataFrame:
    """(a, b) keys (xxhash64) of texts that links at SIMILAR or more join."""
    hashed = docs.select("text", F.xxhash64("text").alias("text_key"))
    every = hashed.mapInArrow(_sketched, "node bigint, weight bigint, bands array<bigint>, slots binary")
    sketched = cut(every.groupBy("node").agg(F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("slots").alias("slots")))
    trees = cut(candidates(sketched, run).join(sketched.select("node", "weight"), "node"))
    heavy = trees.groupBy("tree").agg(F.ceil(F.sum("weight") / weight).alias("chunks"))
    dealt = trees.join(heavy, "tree").select("node", F.explode(_meeting("tree", F.col("chunks"))).alias("run"))
    placed = _placed(docs)
    one = placed.groupBy("__sw_text").agg(F.min(F.struct("__sw_null", "__sw_id")).alias("k")).join(trees.select(F.col("node").alias("__sw_text")), "__sw_text")
    chosen = one.select("k.__sw_null", "k.__sw_id", "__sw_text")
    texts = cut(placed.select(*_PLACE, "text").join(chosen, _PLACE, "left_semi").dropDuplicates(_PLACE).select(F.col("__sw_text").alias("node"), "text"))
    full = texts.join(dealt, "node").select("run", "node", "text").repartition("run").sortWithinPartitions("run", "node")
    return full.mapInArrow(_sure, "a bigint, b bigint")


def keep_one(docs: DataFrame) -> DataFrame:
    """The same columns; one row of each group that SimHash within its radius or similarity joins, the smallest doc_id."""
    rows = cut(simhash.grouped(docs))
    root = rows.groupBy("text_key").agg(F.min("root").alias("root"))
    left, right = (root.select(F.col("text_key").alias(k), F.col("root").alias(r)) for k, r in (("a", "u"), ("b", "v")))
    forest_ = simhash.components(links(docs).join(left, "a").join(right, "b").select("u", "v"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("k"))
    kept = least.join(forest_, least["root"] == forest_["node"], "left").groupBy(F.coalesce(forest_["root"], least["root"])).agg(F.min("k").alias("k"))
    kept = _placed_key(kept, dict(docs.dtypes)["doc_id"])
    # Of rows equal in doc_id and text one stays that is the same in every run.
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    some = _placed(docs).join(kept, _PLACE, "left_semi").select(*_PLACE, every, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("order"))
    return some.groupBy(*_PLACE).agg(F.min_by("row", "order").alias("row")).select("row.*")


def _placed_key(kept: DataFrame, kind: str) -> DataFrame:
    return kept.select(F.col("k.doc_id").isNull().alias("__sw_null"), F.coalesce("k.doc_id", F.lit("0").cast(kind)).alias("__sw_id"), F.col("k.text_key").alias("__sw_text"))
