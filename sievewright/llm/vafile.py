"""Exact top-k by inner product over vector-approximation files (operator 6).

Components become floor(SCALE * x). The approximation table holds, for each row, one byte a component: the number of the
cell that the component lies in. Cells are cut per dimension by quantiles of at most SAMPLE rows; the outermost ones
reach as far as any row does, so that bounds hold for every row. The table is written once (a checkpoint) and is a
quarter of the vectors' size or less.

A search takes three steps for each block of queries:

1. The approximations alone are scanned. A row's cells give bounds of its score for every query; a task returns the rows
   whose upper bound reaches its own kth largest lower bound, and of all those only the ones stay whose upper bound
   reaches the kth largest lower bound of all tasks: the survivors.
2. Exact vectors of the survivors are fetched; no other row's vector is read again.
3. For each query they are taken in descending order of the upper bound, READ at a time, until the next upper bound is
   below the kth exact score. Then the result is certain.

Queries go out in blocks of QUERIES vectors, whatever their number: one pass over the approximations for each block,
which is broadcast and collected within that bound. Of rows with one and the same vector only those with the smallest
ids can be among the k best, so a vector that very many rows share is held for k + 1 ids, k rows each (limits that
start before the shuffle).

Defined results: vectors that are null or have null or non-finite components take no part, nor do empty ones; a query
meets only vectors of its own length; every row with the query's vec_id is its own; a query row that repeats is one
query; ties go to the smaller vec_id, and rows that repeat a vec_id each count; extra columns are ignored; without
queries or candidates the result is empty. Scores beyond 64 bits are compared as doubles and given as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm._batches import cut, segments

SCALE, CELLS = 1024, 256
#: Rows whose quantiles cut the cells.
SAMPLE = 4096
#: Queries of one pass.
QUERIES = 4096
#: Approximations that are scanned at once, and exact vectors that are taken at once for a query.
ROWS, READ = 1024, 32
_SURVIVORS = "query int, query_id bigint, vec_id bigint, key bigint, lower double, upper double"
_RESULT = "query_id bigint, vec_id bigint, score bigint, size double"
_LONG, _MOST = np.iinfo(np.int64), 10**308


def usable(column: str = "embedding"):
    """Whether a vector takes part."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~bad


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles, which hold it exactly; the largest double in place of what they can't hold."""
    top = np.finfo(np.float64).max
    return np.floor(np.clip(SCALE * x.astype(np.float64), -top, top))


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, components) of the batch's rows, by length."""
    column = batch.column("embedding")
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = whole(column.flatten().to_numpy(zero_copy_only=False))
    starts = segments(lengths)[:-1]
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


class Grid:
    """Cells of each dimension: low and high component of each, low[d, 0] and high[d, -1] those of all rows."""

    def __init__(self, sample: list[np.ndarray], least: np.ndarray, most: np.ndarray):
        self.low, self.high = np.empty((len(least), CELLS)), np.empty((len(least), CELLS))
        for d in range(len(least)):
            own = np.sort([v[d] for v in sample if len(v) > d])
            cuts = own[(np.arange(1, CELLS) * len(own)) // CELLS] if len(own) else np.full(CELLS - 1, most[d])
            self.low[d] = np.r_[least[d], np.clip(cuts, least[d], most[d])]
            self.high[d] = np.r_[np.maximum(self.low[d, 1:] - 1, self.low[d, :-1]), most[d]]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        out = np.empty(vectors.shape, np.uint8)
        for d in range(vectors.shape[1]):
            out[:, d] = np.searchsorted(self.low[d, 1:], vectors[:, d], side="right")
        return out

    def centres(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middle and half width of each row's cells."""
        at = np.arange(cells.shape[1])
        low, high = self.low[at, cells], self.high[at, cells]
        return low / 2 + high / 2, high / 2 - low / 2


def grid_of(rows: DataFrame, sample: int = SAMPLE) -> Grid:
    """The driver gets the sample, and a row for each dimension; rows: vec_id, key, embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = np.zeros(0), np.zeros(0)
        for batch in batches:
            for _, v in _vectors(batch):
                fresh = v.shape[1] - len(least)
                if fresh > 0:
                    least, most = np.r_[least, np.full(fresh, np.inf)], np.r_[most, np.full(fresh, -np.inf)]
                least[: v.shape[1]], most[: v.shape[1]] = np.minimum(least[: v.shape[1]], v.min(axis=0)), np.maximum(most[: v.shape[1]], v.max(axis=0))
        yield pa.RecordBatch.from_pydict({"d": pa.array(np.arange(len(least))), "least": pa.array(least), "most": pa.array(most)})

    ends = rows.select("embedding").mapInArrow(run, "d bigint, least double, most double").groupBy("d").agg(F.min("least"), F.max("most")).collect()
    ends = np.array(sorted(tuple(r) for r in ends)).reshape(-1, 3)
    some = rows.select("embedding").orderBy(F.xxhash64("vec_id", "key"), "vec_id", "key").limit(sample).collect()
    return Grid([whole(np.array(r.embedding, np.float64)) for r in some], ends[:, 1], ends[:, 2])


def approximations(rows: DataFrame, grid: Grid, k: int) -> DataFrame:
    """vec_id, key, cells of each row that may be among k best; rows: vec_id, key (of the vector), embedding."""
    shared = rows.sparkSession.sparkContext.broadcast(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, v in _vectors(batch):
                some = pa.array(places)
                cells = shared.value.cells(v)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").take(some), "key": batch.column("key").take(some), "cells": pa.array([c.tobytes() for c in cells], pa.binary())})

    made = rows.mapInArrow(run, "vec_id bigint, key bigint, cells binary")
    one = Window.partitionBy("key", "vec_id").orderBy("vec_id")
    same = Window.partitionBy("key").orderBy("vec_id")
    held = made.withColumn("__n", F.row_number().over(one)).filter(F.col("__n") <= k)
    return held.withColumn("__n", F.dense_rank().over(same)).filter(F.col("__n") <= k + 1).drop("__n")


class Scan:
    """Rows that may be among the k best of some query, from their cells; bounds are rounded outwards."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, grid: Grid, k: int):
        self.ids, self.q, self.grid, self.k = ids, queries, grid, k
        self.lower = np.full((len(ids), k), -np.inf)
        self.size = np.abs(queries).sum(axis=1)
        self.found: list[tuple] = []
        self.held = 0

    def add(self, vec: np.ndarray, key: np.ndarray, cells: np.ndarray) -> None:
        middle, half = self.grid.centres(cells)
        mid = self.q @ middle.T
        slack = np.abs(self.q) @ half.T + (self.size * float(np.abs(middle).max(initial=0)) * 2.0**-40)[:, None] + 1.0
        lower, upper = np.nan_to_num(mid - slack, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(mid + slack, nan=np.inf, posinf=np.inf, neginf=-np.inf)
        own = self.ids[:, None] == vec[None, :]
        lower[own] = upper[own] = -np.inf
        best = np.concatenate([self.lower, lower], axis=1)
        self.lower = np.partition(best, best.shape[1] - self.k, axis=1)[:, best.shape[1] - self.k :]
        q, row = np.nonzero(~own & (upper >= self.lower.min(axis=1)[:, None]))
        self.found.append((q, vec[row], key[row], lower[q, row], upper[q, row]))
        self.held += len(q)
        if self.held > 4 * self.k * len(self.ids) + (1 << 20):
            self.drop()

    def drop(self) -> None:
        """Rows that later ones have ruled out."""
        q, *rest = (np.concatenate(x) for x in zip(*self.found, strict=True))
        stay = rest[-1] >= self.lower.min(axis=1)[q]
        self.found = [(q[stay], *(x[stay] for x in rest))]
        self.held = len(self.found[0][0])

    def rows(self, first: int) -> Iterator[pa.RecordBatch]:
        if not self.found:
            return
        self.drop()
        q, vec, key, lower, upper = self.found[0]
        for at in range(0, len(q), 1 << 16):
            s = slice(at, at + (1 << 16))
            names = ("query", "query_id", "vec_id", "key", "lower", "upper")
            yield pa.RecordBatch.from_arrays([pa.array(q[s] + first, pa.int32()), pa.array(self.ids[q[s]]), *(pa.array(x[s]) for x in (vec, key, lower, upper))], names=names)


def survivors(table: DataFrame, grid: Grid, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """query (place in the list), query_id, vec_id, key, lower, upper of rows that may be among the k best; by cells alone."""
    shared = table.sparkSession.sparkContext.broadcast((grid, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asks = shared.value
        scans: dict[int, list[tuple[int, Scan]]] = {}
        by_length: dict[int, list[int]] = {}
        for n, (_, v) in enumerate(asks):
            by_length.setdefault(len(v), []).append(n)
        for d, places in by_length.items():
            # Blocks of queries of one length, so that scores of ROWS rows are held for some hundreds at once.
            for at in range(0, len(places), 512):
                some = places[at : at + 512]
                scans.setdefault(d, []).append((some, Scan(np.array([asks[n][0] for n in some], np.int64), whole(np.array([asks[n][1] for n in some])), own, k)))
        for batch in batches:
            vec, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "key"))
            lengths = pc.binary_length(batch.column("cells")).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d) if d in scans else np.zeros(0, np.int64)
                for at in range(0, len(rows), ROWS):
                    some = rows[at : at + ROWS]
                    cells = np.frombuffer(b"".join(batch.column("cells").take(pa.array(some)).to_pylist()), np.uint8).reshape(len(some), d)
                    for _, scan in scans[d]:
                        scan.add(vec[some], key[some], cells)
        for blocks in scans.values():
            for places, scan in blocks:
                for out in scan.rows(0):
                    yield out.set_column(0, "query", pa.array(np.array(places, np.int32)[out.column("query").to_numpy()]))

    found = cut(table.mapInArrow(run, _SURVIVORS))
    best = Window.partitionBy("query").orderBy(F.desc("lower"))
    kth = found.select("query", "lower").withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= k)
    bar = kth.groupBy("query").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(float("-inf")).alias("bar"))
    return found.join(bar, "query").filter("upper >= bar").drop("bar")  # a row a query, within the bound of a block


def _dot(q: np.ndarray, v: np.ndarray) -> list[int]:
    """Exact scores."""
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, len(q)) < 2**53:
        return (v @ q).astype(np.int64).tolist()
    own = [int(x) for x in q]
    return [sum(int(x) * y for x, y in zip(row, own, strict=True)) for row in v]


def certain(asks: list[tuple[int, list[float]]], k: int, read: int = READ):
    """A function over batches of survivors (query, query_id, vec_id, upper, embedding), the rows of a query together and by upper bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, best, waiting, done = -1, np.zeros(0), [], [], False
        names = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("size", pa.float64())])

        def take() -> None:
            nonlocal best, waiting
            if waiting:
                scores = _dot(q, np.array([v for _, v in waiting]))
                best = sorted(best + [(-s, i) for s, (i, _) in zip(scores, waiting, strict=True)])[:k]
                waiting = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"query_id": [asks[now][0]] * len(best), "vec_id": [i for _, i in best], "score": [min(_LONG.max, max(_LONG.min, -s)) for s, _ in best], "size": [float(min(_MOST, max(-_MOST, -s))) for s, _ in best]}, schema=names)

        for batch in batches:
            flat, at = whole(batch.column("embedding").flatten().to_numpy(zero_copy_only=False)), 0
            lengths = pc.list_value_length(batch.column("embedding")).to_pylist()
            for query, vec, upper, d in zip(*(batch.column(c).to_pylist() for c in ("query", "vec_id", "upper")), lengths, strict=True):
                if query != now:
                    take()
                    if now >= 0:
                        yield out()
                    now, q, best, done = query, whole(np.array(asks[query][1], np.float64)), [], False
                if not done:
                    if len(waiting) == read:
                        take()
                        done = len(best) == k and upper < -best[-1][0]
                    if not done:
                        waiting.append((vec, flat[at : at + d]))
                at += d
        take()
        if now >= 0:
            yield out()

    return run


def _block(rows: DataFrame, table: DataFrame, grid: Grid, asks: list[tuple[int, list[float]]], k: int) -> DataFrame:
    left = cut(survivors(table, grid, asks, k))
    wanted = left.select("vec_id", "key").distinct()
    exact = rows.join(wanted, ["vec_id", "key"], "left_semi").dropDuplicates(["vec_id", "key"])
    full = left.join(exact, ["vec_id", "key"]).select("query", "vec_id", "upper", "embedding")
    return full.repartition("query").sortWithinPartitions("query", F.desc("upper"), "vec_id").mapInArrow(certain(asks, k), _RESULT)


def search(vectors: DataFrame, is_query, k: int = 10, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row for which is_query (a Column) holds."""
    given = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", is_query.alias("asks")).filter(usable() & F.col("vec_id").isNotNull())
    rows = given.select("vec_id", F.xxhash64("embedding").alias("key"), "embedding")
    asks = given.filter("asks").select("vec_id", "embedding").distinct()
    n = asks.count()
    grid = grid_of(rows)
    table = cut(approximations(rows, grid, k))
    blocks = max(1, -(-n // block)) * (2 if n > block else 1)  # by hash, so twice as many keep within the bound
    found = []
    for b in range(blocks):
        some = asks.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else asks
        found.append(_block(rows, table, grid, [tuple(r) for r in some.collect()], k))
    order = Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("score"), "vec_id")
    return reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
