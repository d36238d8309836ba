"""Exact and near duplicates; what was seen first stays.

Near duplicates agree in at least NEAR_SLOTS of HASHES minimum hashes. With at most 4 of 32 slots different, one of
five bands is equal as a whole, so buckets of equal bands hold every pair. A document is kept if no earlier kept
document is near it; that isn't the first of a connected component: with A near B, B near C, A not near C, both A and C
stay. Rounds settle it; see overtaken().

A crowded bucket is dealt out in chunks of about RUN rows, every two of which meet in a task of their own (a tile), so
no task holds more than some 2 * RUN signatures whatever the size of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import constants as K
from sievewright.functions import text as T
from sievewright.functions.frames import cut
from sievewright.operators import minhash

#: Rows of a bucket that one chunk holds.
RUN = 1024
#: Rows of a bucket, the first ones, that the first round settles; each later round takes as many times more.
LEAD = 64
#: More than there are bands.
MARKS = 64


def exact_hash(text) -> Column:
    return F.sha2(T.normalise(text), 256)


def exact_duplicates(docs: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Adds exact_hash and duplicate: whether an earlier row has the same normalised text; places (order) are distinct.

    The earliest place of a hash is the minimum of a partial aggregation. Rows are then matched with such places by
    their own, so no task meets the copies of a text. The hash comes out of a generator, so that no filter inferred from
    the join computes it once more.
    """
    hashed = docs.select("*", F.explode(F.array(exact_hash(text))).alias("exact_hash"))
    firsts = hashed.groupBy("exact_hash").agg(F.min(F.struct(*order)).alias("__first"))
    firsts = firsts.select(*[F.col(f"__first.{c}").alias(f"__first_{c}") for c in order], F.lit(True).alias("__is_first"))
    same = [hashed[c].eqNullSafe(firsts[f"__first_{c}"]) if hashed.schema[c].nullable else hashed[c] == firsts[f"__first_{c}"] for c in order]
    return hashed.join(firsts, same, "left").withColumn("duplicate", F.col("__is_first").isNull()).drop("__is_first", *[f"__first_{c}" for c in order])


def shingles(text, n: int = K.SHINGLE_WORDS) -> Column:
    """Distinct runs of n words of the normalised text, array<array<string>>; fewer words are one run.

    They are told apart as texts, by a hash table; arrays of arrays are compared each with each.
    """
    return F.transform(F.array_distinct(F.transform(_all_shingles(_normal_words(text), n), lambda s: F.array_join(s, " "))), lambda s: F.array_remove(F.split(s, " "), ""))


def _normal_words(text) -> Column:
    """No pattern is needed: in a normalised text single blanks part words."""
    return F.array_remove(F.split(T.normalise(text), " "), "")


def shingle_count(text, n: int = K.SHINGLE_WORDS) -> Column:
    """How many distinct runs of n words there are."""
    return F.size(F.array_distinct(F.transform(_all_shingles(_normal_words(text), n), lambda s: F.array_join(s, " "))))


def _all_shingles(words: Column, n: int) -> Column:
    return T.let(words, lambda w: F.when(F.size(w) < n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, n))))


def tuple_text(shingle: Column) -> Column:
    """('a', 'b'), or ('a',) of one word, or () of none."""
    inner = F.array_join(shingle, ", ")
    return F.concat(F.lit("("), inner, F.when(F.size(shingle) == 1, F.lit(",)")).otherwise(F.lit(")")))


def _shingle_texts(text, n: int) -> Column:
    """Words are quoted once each, then put together."""
    return F.array_distinct(F.transform(_all_shingles(F.transform(_normal_words(text), minhash.quoted_words), n), tuple_text))


def signature(text, n: int = K.SHINGLE_WORDS, hashes: int = K.HASHES, fast: bool = False) -> Column:
    """Minimum hashes. By default MD5 of "seed_shingle" as hexadecimal digits; fast: XXH64 reseeded, as long.

    As one expression; signed() has the MD5 ones several times faster.
    """
    if fast:
        once = F.array_distinct(F.transform(_all_shingles(_normal_words(text), n), lambda s: F.xxhash64(s)))
        return T.let(once, lambda s: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda k: F.array_min(F.transform(s, lambda h: F.xxhash64(h, k)))))
    mine = lambda s, k: F.array_min(F.transform(s, lambda x: F.md5(F.concat(k.cast("string"), F.lit("_"), x))))
    return T.let(_shingle_texts(text, n), lambda s: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda k: mine(s, k)))


def signed(rows: DataFrame, text: str = "text", fast: bool = False) -> DataFrame:
    """The same columns but text, and signature array<string>; a null text is the empty one."""
    if not fast:
        return minhash.with_signature(rows, text)
    own = F.transform(signature(F.coalesce(F.col(text), F.lit("")), fast=True), lambda h: h.cast("string"))
    return rows.select(*[c for c in rows.columns if c != text], own.alias("signature"))


def agreement(a, b) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def bands(hashes: int = K.HASHES, least: int = K.NEAR_SLOTS) -> list[tuple[int, int]]:
    """(start, length) of one band more than slots may differ."""
    n = hashes - least + 1
    edges = [hashes * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def slots(signature) -> Column:
    """A signature's hashes, 64 bits each: enough to tell whether slots are equal."""
    return F.transform(signature, lambda h: F.xxhash64(h))


def _buckets(signed: DataFrame, hashes: int, least: int) -> DataFrame:
    """(id, bucket) a row for each band; signed: id, slots."""
    each = F.array(*[F.xxhash64(F.lit(k), F.slice("slots", start + 1, n)) for k, (start, n) in enumerate(bands(hashes, least))])
    return signed.select("id", F.explode(each).alias("bucket"))


def _shared(buckets: DataFrame) -> DataFrame:
    """Rows (id, bucket) of buckets with more than one row."""
    return buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "bucket").select("id", "bucket")


def _among(buckets: DataFrame, run: int = RUN, mark: str = "0") -> DataFrame:
    """(run, id, side): rows of a bucket dealt to tiles; rows of one side in a tile of two sides meet elsewhere.

    side modulo MARKS is the bucket's mark, an expression.
    """
    chunks = F.ceil(F.col("n") / run)
    own = F.pmod(F.xxhash64("id"), chunks)
    meets = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.xxhash64("bucket", F.least(c, own), F.greatest(c, own)))
    sized = buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket")
    return sized.select("id", (own * MARKS + F.expr(mark)).cast("int").alias("side"), F.explode(F.when(chunks == 1, F.array("bucket")).otherwise(meets)).alias("run"))


def _between(left: DataFrame, right: DataFrame, run: int = RUN) -> DataFrame:
    """(run, id, side): rows of a bucket dealt so that every left row (side 0) meets every right row (side 1) in one tile."""
    n = lambda rows, name: rows.groupBy("bucket").agg(F.ceil(F.count("*") / run).alias(name))
    sizes = n(left, "ls").join(n(right, "rs"), "bucket")
    one = left.join(sizes, "bucket").select("id", F.lit(0).alias("side"), F.explode(F.transform(F.sequence(F.lit(0), F.col("rs") - 1), lambda c: F.xxhash64("bucket", F.pmod(F.xxhash64("id"), "ls"), c))).alias("run"))
    two = right.join(sizes, "bucket").select("id", F.lit(1).alias("side"), F.explode(F.transform(F.sequence(F.lit(0), F.col("ls") - 1), lambda c: F.xxhash64("bucket", c, F.pmod(F.xxhash64("id"), "rs")))).alias("run"))
    return one.union(two)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, sides, slots) of each tile, by id; a tile's rows come one after the other."""
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in list(zip(*held, strict=True))[1:])

    for batch in batches:
        run, ids, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("run", "id", "side"))
        lists = batch.column("slots")
        values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(run), -1) if len(run) else np.zeros((0, 1), np.int64)
        heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else []
        for a, b in zip(heads, [*heads[1:], len(run)]):
            if held and held[0][0][0] != run[a]:
                yield out()
                held = []
            held.append((run[a:b], ids[a:b], side[a:b], values[a:b]))
    if held:
        yield out()


def _met(tiles: DataFrame, rows: DataFrame, schema: str, work: Callable) -> DataFrame:
    """What work(ids, sides, slots) gives of each tile as columns; rows: id, slots."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _whole(batches):
            yield from (pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names) for columns in work(*tile))

    full = tiles.join(rows, "id").repartition("run").sortWithinPartitions("run", "id")
    return full.select("run", "id", "side", "slots").mapInArrow(run, schema)


def near_pairs(signed: DataFrame, key: str = "doc_id", hashes: int = K.HASHES, least: int = K.NEAR_SLOTS, run: int = RUN) -> DataFrame:
    """(a, b, agree) with a < b for all rows that agree in enough slots; signed: key, signature, each once.

    A pair that shares several bands meets under each and counts under the first.
    """
    edges = bands(hashes, least)
    rows = signed.select(F.col(key).alias("id"), slots("signature").alias("slots"))
    each = F.array(*[F.struct(F.lit(k).alias("no"), F.xxhash64(F.lit(k), F.slice("slots", s + 1, n)).alias("bucket")) for k, (s, n) in enumerate(edges)])
    banded = rows.select("id", F.explode(each).alias("b")).select("id", "b.*")

    def work(ids, sides, values):
        two, no = (sides != sides[0]).any(), int(sides[0]) % MARKS
        for i in range(len(ids) - 1):
            agree = (values[i + 1 :] == values[i]).sum(axis=1)
            near = np.flatnonzero((agree >= least) & ((sides[i + 1 :] != sides[i]) | (not two)))
            if len(near):
                other = i + 1 + near
                same = np.stack([(values[other, s : s + n] == values[i, s : s + n]).all(axis=1) for s, n in edges])
                here = same.argmax(axis=0) == no
                yield np.full(int(here.sum()), ids[i]), ids[other[here]], agree[near[here]].astype(np.int32)

    return _met(_among(banded, run, "no"), rows, "a bigint, b bigint, agree int", work)


def members(signed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, representative) of every row: the smallest key with its whole signature; signed: key, signature.

    Signatures are told apart by their SHA-256, a thirtieth of their size, so they are neither kept nor moved.
    """
    own = cut(signed.select(key, F.unhex(F.sha2(F.concat_ws(" ", "signature"), 256)).alias("__same")))
    firsts = own.groupBy("__same").agg(F.min(key).alias("representative"))
    return own.join(firsts, "__same").select(key, "representative")


def _near(values: np.ndarray, other: np.ndarray, least: int) -> np.ndarray:
    """Whether any of the other signatures is near, for each of the values."""
    out = np.zeros(len(values), bool)
    for at in range(0, len(values), 256):
        some = values[at : at + 256]
        agree = np.zeros((len(some), len(other)), np.uint8)
        for k in range(values.shape[1]):
            agree += some[:, k, None] == other[None, :, k]
        out[at : at + 256] = (agree >= least).any(axis=1)
    return out


def near_to(stored: DataFrame, rows: DataFrame, hashes: int = K.HASHES, least: int = K.NEAR_SLOTS) -> DataFrame:
    """Distinct ids of rows near a stored one; both: id, slots, and no id of both."""

    def work(ids, sides, values):
        late = np.flatnonzero(sides == 1)
        yield (ids[late[_near(values[late], values[sides == 0], least)]],)

    tiles = _between(_buckets(stored, hashes, least), _buckets(rows, hashes, least))
    return _met(tiles, stored.select("id", "slots").union(rows.select("id", "slots")), "id bigint", work).distinct()


def overtaken(signed: DataFrame, hashes: int = K.HASHES, least: int = K.NEAR_SLOTS, lead: int = LEAD) -> DataFrame:
    """Ids (column id) that are near a smaller id that stays; signed: id, slots, ids distinct.

    In each round the first open ids of every bucket lead it: LEAD of them, and as many times more in each later round.
    Leaders meet each other. An id that leads all its buckets has met every open candidate before it; if none of them is
    near, it stays. Then all open rows meet those that stay, and rows near one go. So a group of near copies goes at
    its first one, rows that share a bucket without being near take few rounds however many they are, and otherwise a
    round follows each link of a chain. Rows alone in all their buckets take no part.
    """
    rows = cut(signed.select("id", "slots"))
    open_ = cut(_shared(_buckets(rows, hashes, least)))
    gone = []

    def earlier(ids, sides, values):
        two, late = (sides != sides[0]).any(), np.zeros(len(ids), bool)
        for i in range(len(ids) - 1):
            late[i + 1 :] |= ((values[i + 1 :] == values[i]).sum(axis=1) >= least) & ((sides[i + 1 :] != sides[i]) | (not two))
        yield (ids[late],)

    def follow(ids, sides, values):
        first, late = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        yield (ids[late[_near(values[late], values[first], least)]],)

    while not open_.isEmpty():
        order = Window.partitionBy("bucket").orderBy("id")
        leaders = cut(open_.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= lead).drop("n"))
        places = leaders.groupBy("id").agg(F.count("*").alias("led"))
        ripe = open_.groupBy("id").agg(F.count("*").alias("in")).join(places, "id").filter(F.col("led") == F.col("in")).select("id")
        late = _met(_among(leaders), rows, "id bigint", earlier)
        stays = cut(ripe.join(late.distinct(), "id", "left_anti"))
        rest = open_.join(stays, "id", "left_anti")
        goes = cut(_met(_between(open_.join(stays, "id", "left_semi"), rest), rows, "id bigint", follow).distinct())
        gone.append(goes)
        open_ = cut(_shared(rest.join(goes, "id", "left_anti")))
        lead *= LEAD
    out = rows.select("id").limit(0)
    for g in gone:
        out = out.union(g)
    return out


def near_duplicates(docs: DataFrame, text: str, key: str = "doc_id", fast: bool = False, most: int | None = None) -> DataFrame:
    """(key, near_duplicate) of rows with distinct keys in order of arrival.

    Rows with one signature behave alike, so only the earliest of each meets others. most: only so many kept rows, the
    first ones, are compared with; later rows are held against those alone.
    """
    own = cut(signed(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "text", fast).select("id", slots("signature").alias("slots")))
    firsts = cut(own.groupBy("slots").agg(F.min("id").alias("id")))
    gone = overtaken(firsts)
    if most is not None:
        stored = cut(firsts.join(gone, "id", "left_anti").orderBy("id").limit(most))
        n, last = stored.agg(F.count("*"), F.max("id")).first()
        if n == most:
            late = firsts.filter(F.col("id") > last)
            gone = gone.filter(F.col("id") < last).union(near_to(stored, late))
    lost = gone.select(F.col("id").alias("first"), F.lit(True).alias("lost"))
    same = own.join(firsts.withColumnRenamed("id", "first"), "slots").join(lost, "first", "left")
    late_copy = F.lit(True) if most is None else F.lit(True) if n < most else (F.col("first") <= last)
    return same.select(F.col("id").alias(key), (F.coalesce("lost", F.lit(False)) | ((F.col("id") != F.col("first")) & late_copy)).alias("near_duplicate"))


def deduplicate(docs: DataFrame, text: str, key: str = "doc_id", fast: bool = False, most: int | None = None) -> DataFrame:
    """Adds dup_reason: exact_duplicate, near_duplicate or null. Exact copies never reach the near test."""
    exact = cut(exact_duplicates(docs, text, [key]))
    near = near_duplicates(exact.filter(~F.col("duplicate")), text, key, fast, most).withColumnRenamed(key, "__key")
    joined = exact.join(near, exact[key] == near["__key"], "left")
    why = F.when(F.col("duplicate"), "exact_duplicate").when(F.coalesce("near_duplicate", F.lit(False)), "near_duplicate")
    return joined.withColumn("dup_reason", why).drop("__key", "near_duplicate", "duplicate", "exact_hash")


def first_seen(docs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return docs.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")
