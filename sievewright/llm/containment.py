"""Document fingerprints (operator 2). DataFrame functions only.

A threshold-scaled sketch keeps every shingle hash below a fixed fraction of the hash range, whatever the document's
length, so sketches of any two documents are samples of the same hashes: the union of two sketches is the sketch of the
union, and shares of common hashes estimate likeness and containment. A fingerprint is the hash of all words, which
tells whether two documents are the same to the method, followed by the sketch.

Shingles are of SHINGLE words, lower-cased, of [^\\x20\\x09-\\x0D]+; fewer words are one shingle, no words none.
A shingle's hash is XXH64 chained over its words' XXH64.

next_document() pairs each document with the next one by doc_id without a global window: places (doc_id, then the
text's hash) are cut into at most BLOCKS blocks of about BLOCK rows by their quantiles, so ids may be spread in any
way; a first pass reads ids alone (and texts only of ids that fill several blocks by repeating). Quantiles are places
of rows, so the row at a block's lower bound is the block's first, and the second pass lends it to the block before.

Defined results: a null text is the empty text; an empty text has no shingles, and is like another one without words
(1.0) and unlike any other (0.0); equal texts have equal fingerprints; documents with shingles of which none is below
the threshold are alike only if all their words are; null ids come first; rows that repeat an id are ordered by text;
the last document's next is the first, and a lone document is its own next; extra columns are ignored; an empty table
gives an empty result. Rows equal in id and text stand in one block.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm._batches import let

SHINGLE, ONE_IN = 5, 2
#: Signed hashes below this are the smallest 1 / ONE_IN of all.
LIMIT = -(2**63) + 2**64 // ONE_IN
#: Rows of a block; blocks at most, of which the driver gets a bound each.
BLOCK, BLOCKS = 512, 1 << 16
BLANKS = " \t\n\x0b\x0c\r"
LEAST = -(2**63)


def word_hashes(text: Column) -> Column:
    """array<bigint> of the text's words in order."""
    trimmed = F.btrim(F.lower(text), F.lit(BLANKS))
    words = F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(words)


def shingled(words: Column, shingle: int = SHINGLE, limit: int = LIMIT) -> Column:
    """Sorted distinct hashes below the limit of the shingles of hashed words, array<bigint>."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(shingle)]))
    every = F.when(n == 0, F.array().cast("array<bigint>")).when(n < shingle, F.array(F.xxhash64(words))).otherwise(many)
    return F.sort_array(F.array_distinct(F.filter(every, lambda h: h < limit)))


def sketch(text: Column, shingle: int = SHINGLE, limit: int = LIMIT) -> Column:
    """Sorted distinct hashes that the text keeps, array<bigint>."""
    return let(word_hashes(text), lambda w: shingled(w, shingle, limit))


def fingerprint(text: Column) -> Column:
    """struct<whole, kept>: the hash of all words, and the sketch."""
    return let(word_hashes(text), lambda w: F.struct(F.xxhash64(w).alias("whole"), shingled(w).alias("kept")))


def _shared(a: Column, b: Column, size) -> Column:
    """Common hashes over size(common, a, b); two empty sketches are alike."""
    both = lambda p: F.size(F.array_intersect(p["a"], p["b"]))
    ratio = lambda p: let(both(p), lambda n: let(size(n, F.size(p["a"]), F.size(p["b"])), lambda m: F.when(m > 0, n / m).otherwise(F.lit(0.0))))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(F.struct(a.alias("a"), b.alias("b")), ratio))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of two documents, 0 to 1, of their sketches."""
    return _shared(a, b, lambda n, x, y: x + y - n)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document's shingles that the larger has, 0 to 1, of their sketches."""
    return _shared(a, b, lambda n, x, y: F.least(x, y))


def of_fingerprints(measure, a: Column, b: Column) -> Column:
    """likeness or containment of two fingerprints; 1 for the same words, 0 where neither kept a hash of its own."""
    empty = (F.size(a["kept"]) == 0) & (F.size(b["kept"]) == 0)
    return F.when(a["whole"] == b["whole"], 1.0).when(empty, 0.0).otherwise(measure(a["kept"], b["kept"]))


def merged(a: Column, b: Column) -> Column:
    """Sketch of two documents' shingles together, of their sketches."""
    return F.sort_array(F.array_union(a, b))


def hexed(f: Column) -> Column:
    """Fingerprint as hexadecimal digits, 16 a hash, that of all words first."""
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(digits(f["whole"]), F.array_join(F.transform(f["kept"], digits), ""))


@dataclass
class Blocks:
    """Lower bounds of blocks in order: places of rows. Places of ids that fill no block by repeating have no hash."""

    bounds: list[tuple[bool, int, int]]
    crowded: list[int]
    nulls: bool

    def place(self) -> Column:
        """struct<known, id, key> of a row with doc_id and text: what blocks are cut by."""
        many = F.col("doc_id").isin(self.crowded) if self.crowded else F.lit(False)
        many |= F.col("doc_id").isNull() if self.nulls else F.lit(False)
        key = F.when(many, F.xxhash64("text")).otherwise(F.lit(LEAST)) if self.crowded or self.nulls else F.lit(LEAST)
        return F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), key.alias("key"))

    def bound(self, k: Column) -> Column:
        listed = lambda at, kind: F.get(F.split(F.lit(",".join(str(c[at]).lower() for c in self.bounds)), ",").cast(f"array<{kind}>"), k)
        return F.struct(listed(0, "boolean").alias("known"), listed(1, "bigint").alias("id"), listed(2, "bigint").alias("key"))

    def block(self, place: Column) -> Column:
        """Number of the last bound that isn't above the place, found by halving."""
        widths = [1 << k for k in range(len(self.bounds).bit_length(), -1, -1)]
        step = lambda low, width: F.when((low + width < len(self.bounds)) & (self.bound(low + width) <= place), low + width).otherwise(low)
        return F.aggregate(F.array(*map(F.lit, widths)), F.lit(0), step)


def blocks_of(docs: DataFrame, rows: int = BLOCK, most: int = BLOCKS) -> Blocks:
    """Blocks of about so many rows, or as many more as `most` blocks make of them; docs: doc_id, text.

    Quantiles of the ids are near enough to cut by; an id at several of them repeats in that many blocks' worth of rows,
    and equal ranges of its texts' hashes cut it. Then each block's first place replaces what cut it.
    """
    n, known = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if not n:
        return Blocks([(False, 0, LEAST)], [], False)
    parts = max(1, min(most, -(-n // rows)))
    ids = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(parts)], 10 * parts)).first()[0] or []
    out = Blocks([(True, int(i), LEAST) for i in set(ids)], sorted({int(i) for i, j in zip(ids, ids[1:]) if i == j}), known < n)
    times = Counter(map(int, ids))
    full = [(i, True, times[i]) for i in out.crowded] + [(0, False, max(1, (n - known) * parts // n))] * out.nulls
    out.bounds = sorted({*out.bounds, *((real, i, LEAST + 2**64 * k // m) for i, real, m in full for k in range(m))})
    placed = docs.select(out.place().alias("place"))
    firsts = placed.groupBy(out.block(F.col("place"))).agg(F.min("place").alias("first")).collect()
    out.bounds = sorted(tuple(r["first"]) for r in firsts)
    return out


def next_document(docs: DataFrame, carried: list[tuple[str, Column]], blocks: Blocks) -> DataFrame:
    """The rows, each with the carried columns (name, value) and those of the next row by doc_id (then text) as next_name.

    docs: doc_id, text and what the columns need. A row at its block's lower bound may be the block's first and is lent
    to the block before. Values are computed behind the exchange, once a row; windows that follow each other share it.
    """
    ranged = docs.withColumn("__place", blocks.place()).withColumn("__block", blocks.block(F.col("__place")))
    own = F.struct(F.col("__block").alias("b"), F.lit(False).alias("l"))
    before = F.struct(F.pmod(F.col("__block") - 1, F.lit(len(blocks.bounds))).alias("b"), F.lit(True).alias("l"))
    places = F.when(F.col("__place") == blocks.bound(F.col("__block")), F.array(own, before)).otherwise(F.array(own))
    both = ranged.withColumn("__at", F.explode(places)).withColumns({"__block": F.col("__at.b"), "__lent": F.col("__at.l"), "__key": F.xxhash64("text")}).drop("__at", "__place")
    order = Window.partitionBy("__block").orderBy("__lent", F.col("doc_id").asc_nulls_first(), "__key")
    for name, value in carried:
        both = both.withColumn(name, value).withColumn(f"next_{name}", F.lead(name).over(order))
    return both.filter(~F.col("__lent")).drop("__lent", "__block", "__key")


def fingerprint_edits(docs: DataFrame, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_edited."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    paired = next_document(rows, [("text", F.col("text")), ("own", fingerprint(F.col("text")))], blocks_of(rows, block, blocks))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    made = paired.select("doc_id", n.cast("bigint").alias("n_chars"), "own", F.col("next_own").alias("after"), let(edited, lambda e: F.struct(F.sha2(F.encode(e, "UTF-8"), 256).alias("sha"), fingerprint(e).alias("f"))).alias("e"))
    own, new, after = F.col("own"), F.col("e.f"), F.col("after")
    return made.select(
        "doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), hexed(own).alias("fingerprint"), hexed(new).alias("edited_fingerprint"),
        of_fingerprints(likeness, own, new).alias("near_edited"), of_fingerprints(likeness, own, after).alias("near_next"), of_fingerprints(containment, own, new).alias("contained_edited"),
    )
