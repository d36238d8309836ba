"""SimHash near-duplicates (operator 3).

Fingerprints: 64 bits, one pass in Arrow batches. Distinct fingerprints (copies collapse in a partial aggregation) are
dealt into six tables: with the 64 bits in four blocks, two fingerprints at most two bits apart agree on at least two
blocks, so some table holds both under one key; nothing is missed. Keys with one fingerprint are dropped, a key with
more than RUN is split into chunks, and every two chunks meet in a task of their own.

Comparison is bit-sliced: within a task the fingerprints stand as 64 bit planes of 64-row words. For a row, a word of
its key's rows is compared at once: plane by plane, the differing bits go through a carry-save counter of two bits and
an overflow plane; after every eight planes, the words whose 64 distances are all beyond the radius are abandoned.
What a task finds leaves it as a spanning forest (each fingerprint with the least of its tree), not as all pairs.
Trees are joined by alternating large-star and small-star rounds, each cut by a reliable checkpoint.

Defined results: a text without words, empty or null, has fingerprint zero, which links like any other; repeated rows
and equal texts share a fingerprint; a null doc_id is never the smallest one of a group with another id; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm._batches import cut, slices
from sievewright.llm._words import LOWER, SPACE, buffer, runs

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Distinct fingerprints under one key that one task compares.
RUN = 8192
#: Two of the four 16-bit blocks, for each of the six tables.
MASKS = [(0xFFFF << 16 * a) | (0xFFFF << 16 * b) for a in range(4) for b in range(a)]

#: The eight bits of a byte, each in a byte of its own.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(column: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, hash) of each run of words, text by text; a text of fewer words is one run, one without words none."""
    raw, starts = buffer(column)
    space = SPACE[raw]
    keep = ~space
    keep[1:] |= ~space[:-1]  # one blank behind each word
    keep[0] = False
    kept = np.flatnonzero(keep)
    if not len(kept):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = np.searchsorted(starts, kept, side="right") - 1
    flat = LOWER[raw[kept]]
    flat[space[kept]] = 32
    begin, end = runs(np.r_[False, ~space[kept], False])
    begin, end = begin - 1, end - 1
    doc = own[begin]
    n = np.bincount(doc, minlength=len(starts))
    ahead = np.minimum(np.arange(len(doc)) + shingle - 1, len(doc) - 1)
    full = (doc[ahead] == doc) & (np.arange(len(doc)) + shingle - 1 < len(doc))
    short = np.zeros(len(doc), bool)
    first = np.r_[True, doc[1:] != doc[:-1]]
    short[first] = n[doc[first]] < shingle
    last = np.where(full, ahead, np.arange(len(doc)) + n[doc] - 1)
    use = np.flatnonzero(full | short)
    data, hashed = flat.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((hashed(data[a:b], seed) for a, b in zip(begin[use].tolist(), end[last[use]].tolist(), strict=True)), np.uint64, len(use))
    return doc[use], h


def fingerprints(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """SimHash of each text as uint64."""
    per, h = shingle_hashes(column, shingle, seed)
    out = np.zeros(len(column), np.uint64)
    if not len(per):
        return out
    heads = np.flatnonzero(np.r_[True, per[1:] != per[:-1]])
    total = np.diff(np.r_[heads, len(per)])
    place = np.arange(len(per)) - np.repeat(heads, total)
    parts = np.flatnonzero(place % 255 == 0)  # as many as a byte can count
    lanes = np.add.reduceat(_LANES[h.view(np.uint8).reshape(-1, 8)], parts, axis=0).view(np.uint8)
    over = np.add.reduceat(lanes, np.searchsorted(parts, heads), axis=0, dtype=np.int32) * 2 > total[:, None]
    out[per[heads]] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text, to tell rows of one doc_id apart), fp long of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = fingerprints(part.column("text")).view(np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "fp": pa.array(fp)})

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key bigint, fp bigint")


def roots(n: int, left: np.ndarray, right: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least index of each one's tree, joining the edges into the trees of label."""
    label = np.arange(n) if label is None else label
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up
    return label


def near_forest(run: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint the least index of its tree of links; run: equal neighbours are compared with each other."""
    n = len(fp)
    heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[heads, n])
    low, high = np.repeat(heads, sizes), np.repeat(heads + sizes, sizes)
    words = (n + 63) // 64
    padded = np.zeros(words * 64, np.uint64)
    padded[:n] = fp
    upright = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(words, 64, 64).transpose(2, 0, 1)
    planes = np.packbits(np.ascontiguousarray(upright), axis=2, bitorder="little").view(np.uint64).reshape(64, words)
    ones, zero = np.uint64(2**64 - 1), np.uint64(0)
    label, each = np.arange(n), np.arange(n)
    for step in range(int(((high - 1) // 64 - np.arange(n) // 64).max(initial=0)) + 1):  # a row meets the words from its own on
        rows = each[each // 64 + step <= (high - 1) // 64]
        for at in range(0, len(rows), 1 << 18):
            row = rows[at : at + (1 << 18)]
            word = row // 64 + step
            one, two, over = (np.zeros(len(row), np.uint64) for _ in range(3))
            for b in range(64):
                differs = planes[b, word] ^ np.where((fp[row] >> np.uint64(b)) & np.uint64(1), ones, zero)
                carry = one & differs
                one ^= differs
                over |= two & carry
                two ^= carry
                if b % 8 == 7:
                    beyond = over | (one & two) if radius == 2 else over
                    alive = np.flatnonzero(beyond != ones)
                    if len(alive) < len(row):
                        row, word, one, two, over = row[alive], word[alive], one[alive], two[alive], over[alive]
                    if not len(row):
                        break
            if not len(row):
                continue
            near = ~(over | (one & two))
            for part in range(0, len(row), 1 << 14):
                found = np.unpackbits(near[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                i, j = np.nonzero(found)
                i, j = row[part + i], word[part + i] * 64 + j
                real = (j > i) & (j < high[i]) & (j >= low[i])
                label = roots(n, i[real], j[real], label)
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): fingerprints of one tree, b the first of them in its run; a run's rows come one after the other."""
    held = None

    def out(run: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        root = near_forest(run, fp)
        linked = root != np.arange(len(fp))
        return pa.RecordBatch.from_pydict({"a": pa.array(fp[linked].view(np.int64)), "b": pa.array(fp[root[linked]].view(np.int64))})

    for batch in batches:
        run, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("run", "fp"))
        fp = fp.view(np.uint64)
        if held is not None:
            run, fp = np.concatenate([held[0], run]), np.concatenate([held[1], fp])
        if not len(run):
            continue
        start = len(run) - int(np.argmax(run[::-1] != run[-1])) if (run != run[-1]).any() else 0
        held = run[start:], fp[start:]
        if start:
            yield out(run[:start], fp[:start])
    if held is not None:
        yield out(*held)


def links(reps: DataFrame, run: int = RUN) -> DataFrame:
    """(a, b) fingerprints that lie in one group; reps: fp, distinct."""
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.expr(f"fp & {m if m < 2**63 else m - 2**64}L" if m != 2**63 else "fp").alias("m")) for k, m in enumerate(MASKS)]))
    keyed = reps.select("fp", key.alias("k")).select("fp", F.xxhash64("k.t", "k.m").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / run)
    own = F.pmod(F.xxhash64("fp"), chunks)
    meets = F.when(chunks == 1, F.array(F.xxhash64("key"))).otherwise(F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.xxhash64("key", F.least(c, own), F.greatest(c, own))))
    dealt = keyed.join(crowded, "key").select("fp", F.explode(meets).alias("run"))
    return dealt.repartition("run").sortWithinPartitions("run", "fp").mapInArrow(_links, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that is reachable, for every node of the edges (u, v long) but the roots.

    Large star: every node sends its larger neighbours to the least of its neighbours and itself; small star: its
    smaller ones and itself. Both keep what is connected; the rounds end when nothing changes.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        sent = both.join(least, "u")
        out = sent.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else sent.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        return out.filter("u <> v").distinct()

    edges = cut(edges.filter("u <> v").distinct())
    before = None
    while True:
        edges = cut(star(star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp, component_id (smallest doc_id reachable) and root (a fingerprint for the group) of each row."""
    rows = cut(with_fingerprint(docs))
    reps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    forest = components(links(reps.select("fp")).select(F.col("a").alias("u"), F.col("b").alias("v")))
    of_fp = reps.join(forest, reps.fp == forest.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of_fp.select("fp", "root").join(least, "root"), "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each row."""
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The same columns; of each group the row with the smallest doc_id (among rows of one doc_id, one text)."""
    kept = grouped(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("__sw_id"), F.col("k.text_key").alias("__sw_key"))
    hashed = docs.withColumn("__sw_text", F.xxhash64("text"))
    joined = hashed.join(kept, hashed["doc_id"].eqNullSafe(kept["__sw_id"]) & (hashed["__sw_text"] == kept["__sw_key"]), "left_semi")
    return joined.dropDuplicates(["doc_id", "__sw_text"]).drop("__sw_text")
