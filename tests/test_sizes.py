"""What a worker or a task holds at once, and names and results beyond the sizes of small tables."""

from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import dedup, gates, minhash, pack, tokens
from sievewright.sources import chunks

PROSE = "the quick brown fox jumps, over a lazy dog. "


@pytest.fixture(scope="module")
def model(spark):
    return tokens.train(spark.createDataFrame([(PROSE,)] * 20, "text string"), vocab=300)


def worker(name: str, kind: str, make):
    """The function that Python workers run, taken from a stand-in for a frame of one column."""
    field = SimpleNamespace(name=name, dataType=SimpleNamespace(simpleString=lambda: kind))
    context = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))
    return make(SimpleNamespace(columns=[name], schema=SimpleNamespace(fields=[field]), sparkSession=SimpleNamespace(sparkContext=context), mapInArrow=lambda run, schema: run))


def test_token_workers_hold_few_tokens(model):
    """Ten thousand rows come as one batch; what is made of them at once goes by tokens, however long the texts."""
    texts = pa.RecordBatch.from_pydict({"text": pa.array([PROSE * 500, None, ""] + [PROSE * 20] * 60)})
    coded = list(worker("text", "string", lambda docs: tokens.encode(docs, model))(iter([texts])))
    ids = [i for b in coded for i in b.column("tokens").to_pylist()]
    sp = tokens._opened(model)
    assert ids == [sp.encode(t or "") for t in texts.column("text").to_pylist()]
    batch = pa.RecordBatch.from_pydict({"tokens": pa.array([*(ids * 8), None], pa.list_(pa.int32()))})
    for make, want in ((tokens.pieces, sp.id_to_piece), (tokens.safe_decode, lambda i: tokens.decoded(sp, i))):
        made = list(worker("tokens", "array<int>", lambda docs, make=make: make(docs, model))(iter([batch])))
        assert max(len(b.column("tokens").flatten()) for b in made if b.num_rows > 1) <= tokens.TOKENS < len(batch.column("tokens").flatten())
        assert [x for b in made for x in b.column(1).to_pylist()] == [*[want(i) for i in ids * 8], None]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_measures_split_a_text_once(spark):
    """Words go into the count and the dominant share; text is cut at blanks, not by a pattern of all white space."""
    docs = spark.createDataFrame([(0, PROSE)], "doc_id bigint, text string")
    made = plan(gates.with_reason(docs))
    assert made.count("split(") == 1
    assert f", [{T.WS}]+, -1)" not in made


def test_words_at_every_kind_of_white_space(spark):
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts = [f"A{c}b{c}{c}É c{c}" for c in spaces] + ["“a” b​c", " ", " ", "", " a  b ", "x \n y", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("i", T.words("t").alias("w"), T.word_count("t").alias("n"), T.normalise("t").alias("x")).collect():
        t = texts[r.i]
        assert (r.w, r.x) == ((None, None) if t is None else (t.split(), " ".join(t.lower().split())))
        assert t is None or r.n == len(r.w)


def test_shingles_are_told_apart_by_hashing(spark):
    """Arrays of arrays would be compared each with each; see the element type that array_distinct is given."""
    text = " ".join(f"w{i % 700}" for i in range(1500))
    rows = spark.createDataFrame([(0, text), (1, "A b"), (2, ""), (3, "a " * 9)], "doc_id bigint, text string")
    made = rows.select("doc_id", dedup.shingle_count("text").alias("n"), F.size(dedup.shingles("text")).alias("m"))
    assert [(r.n, r.m) for r in made.orderBy("doc_id").collect()] == [(700, 700), (1, 1), (1, 1), (1, 1)]
    assert rows.filter("doc_id = 1").select(dedup.shingles("text").alias("s")).first().s == [["a", "b"]]
    for own in (dedup.shingle_count("text"), dedup.shingles("text"), dedup.signature("text", fast=True)):
        assert "array_distinct(transform(" in plan(rows.select(own))


def test_names_of_many_chunks_stay_whole(spark):
    rows = spark.createDataFrame([(7,), (12345,), (123456,)], "chunk_id bigint")
    assert [r.n for r in rows.select(pack.chunk_name(per=2).alias("n")).collect()] == ["shard_003/chunk_0007.bin", "shard_6172/chunk_12345.bin", "shard_61728/chunk_123456.bin"]


def test_many_small_chunk_files_take_few_tasks(spark, tmp_path):
    made = spark.range(300).select(F.col("id").alias("chunk_id"), F.lit(0).cast("bigint").alias("offset"), F.array(F.col("id").cast("int"), F.lit(7)).alias("tokens"))
    chunks.write(made, str(tmp_path / "many"))
    back = chunks.read(spark, str(tmp_path / "many"), 1)
    assert back.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted((r.chunk_id, r.offset, r.tokens) for r in back.collect()) == [(c, at, [t]) for c in range(300) for at, t in enumerate((c, 7))]


def test_totals_do_not_make_tokens_again(spark):
    docs = spark.createDataFrame([(0, 0, 0, "a b c"), (1, 0, 3, "d e"), (2, 1, 0, "f")], "doc_id int, source_rank int, before bigint, text string")
    rows = docs.select("doc_id", "source_rank", "before", F.size(F.split("text", " ")).alias("n"), F.upper("text").alias("u")).withColumn("tokens", F.transform(F.split("u", " "), F.length))
    parts = pack.chunk_parts(rows, 4, count="n")
    assert plan(parts).count("upper(") == 1
    assert sorted(tuple(r) for r in parts.collect()) == sorted(tuple(r) for r in pack.chunk_parts(rows, 4).collect())


def test_texts_become_quoted_words_without_a_pattern_a_word(spark):
    """A word at a time only where one holds a quote or a backslash."""
    rows = spark.createDataFrame([(0, "a b"), (1, ""), (2, "it's a \\ \"x\"")], "doc_id bigint, text string")
    got = [r.q for r in rows.select("doc_id", minhash.quoted_text(F.col("text")).alias("q")).orderBy("doc_id").collect()]
    assert got == ["'a', 'b', ", "", "\"it's\", 'a', '\\\\', '\"x\"', "]


def test_members_move_digests_alone(spark):
    rows = dedup.signed(spark.createDataFrame([(3, "a b"), (1, "c d"), (2, "A  b")], "doc_id bigint, text string"))
    made = dedup.members(rows)
    assert sorted(tuple(r) for r in made.collect()) == [(1, 1), (2, 2), (3, 2)]
    assert "signature" not in made._jdf.queryExecution().analyzed().toString()
