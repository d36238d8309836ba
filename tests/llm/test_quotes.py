"""Quotation links against the same rules in SQL, over made-up threads, and literal rows."""

import random

import duckdb

from sievewright.llm import queries, quotes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, hash string, thread string"


def threads(n):
    random.seed(3)
    rows, words = [], ["Alpha", "beta", "gamma", "delta", "eps"]
    for c in range(n):
        seen = []
        for t in range(random.randint(1, 8)):
            own = "\n".join(" ".join(random.choices(words, k=random.randint(0, 5))) for _ in range(random.randint(1, 4)))
            text = own
            if seen and random.random() < 0.8:
                given = random.choice(seen)
                lines = given.split("\n")
                lines = random.sample(lines, random.randint(1, len(lines))) if random.random() < 0.4 else lines
                own = "Yes. " + own if random.random() < 0.2 else own
                text = random.choice(["", "Ann wrote:\n", "On x schrieb : \r\n"]) + "\n".join(random.choice(["> ", ">", ">  "]) + x.upper() for x in lines) + "\n" + own
                if random.random() < 0.3:
                    text = own + "\n\n" + "\n".join("> " + x for x in given.split("\n"))
            seen.append(text)
            rows.append((c or None, t, random.choice(["user", "assistant", None]), text if random.random() > 0.03 else None, "x", "y"))
    return rows + rows[:20] + [(5, None, "user", "> hi", "x", "y")]


def test_links_as_sql(spark, tmp_path):
    given = spark.createDataFrame(threads(60), SCHEMA)
    given.coalesce(1).write.parquet(str(tmp_path / "t"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/t/*.parquet'")
    want = con.sql(queries.ORACLES["op1_quotation_links"])
    linked = quotes.link(given)
    got = quotes.conversations(linked)
    assert got.columns == want.columns
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))
    assert sum(r[3] > 1 for r in rows) > 30 and sum(r[3] for r in rows) == given.count()
    assert sum(r.n_linked > 0 for r in linked.collect()) > 50


def test_literal_thread(spark):
    rows = [
        (1, 0, "user", "How do I bake bread?\n\nI have flour."), (1, 1, "assistant", "> I have flour.\nMix it with water."), (1, 2, "user", "Other question here please."),
        (1, 3, "assistant", "Bob wrote:\n>> I have flour.\n> Mix it   with WATER.\nThen wait."), (1, 4, "user", "> never said by anyone\nok"), (1, 5, "user", None), (1, 6, "user", "> \n>\n"), (2, 0, "user", ""),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert [got[1, t].reply_to for t in range(7)] == [None, 0, None, 1, None, None, None]
    assert [got[1, t].thread for t in range(7)] == [0, 0, 2, 0, 4, 5, 6]
    assert got[1, 3].clean_text == "Then wait." and got[1, 3].chat == "<assistant>Then wait." and got[1, 3].n_passages == 2 and got[1, 3].n_linked == 2
    assert got[1, 4].n_passages == 1 and got[1, 4].n_linked == 0 and got[1, 5].clean_text == "" and got[2, 0].thread == 0
    assert quotes.link(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []


def test_sentences_and_short_lines(spark):
    rows = [
        (1, 0, "user", "First point is made here. Second point goes\non over two lines! Third one?"), (1, 1, "assistant", "> second point goes on over two lines!\nI agree."), (1, 2, "user", "Yes please\nand thanks"),
        (1, 3, "assistant", "> Yes please\nDone."), (1, 4, "user", "> point goes\nNo such unit."), (1, 5, "user", "> I agree.\n\n> Done.\nBoth."),
    ]
    linked = quotes.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.turn: r for r in linked.collect()}
    assert [got[t].reply_to for t in range(6)] == [None, 0, None, 2, None, 3]
    assert [(got[t].thread, got[t].position) for t in range(6)] == [(0, 0), (0, 1), (2, 0), (2, 1), (4, 0), (2, 2)]
    talk = {r.thread: r for r in quotes.conversations(linked).collect()}
    assert talk[2].turns == "2,3,5" and talk[2].parents == "-,2,3" and talk[2].chat == "<user>Yes please\nand thanks\n<assistant>Done.\n<user>Both." and talk[0].turns == "0,1"


def test_one_passage_that_everyone_quotes(spark):
    """A hot conversation: 3,000 messages quote one passage; the thread comes in parts, in order."""
    rows = [(1, 0, "user", "Everyone quotes this passage here.")] + [(1, t, "user", f"> Everyone quotes this passage here.\nreply {t}") for t in range(1, 3001)] + [(c, 0, "user", "alone") for c in range(2, 500)]
    got = quotes.conversations(quotes.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    hot = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.part)
    assert [r.n_turns for r in hot] == [512] * 5 + [441] and ",".join(r.turns for r in hot) == ",".join(map(str, range(3001)))
    assert len(got) == 6 + 498 and set(",".join(r.parents for r in hot).split(",")) == {"-", "0"}


def test_long_chains_and_long_messages(spark):
    chain = [(7, t, "user", (f"> message number {t - 1} has words\n" if t else "") + f"message number {t} has words") for t in range(70)]
    long = [(8, 0, "user", "\n".join(("> " if i % 2 else "") + f"line {i} of many" for i in range(4000)))]
    got = quotes.link(spark.createDataFrame(chain + long, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert all(r.thread == 0 and r.reply_to == (r.turn - 1 if r.turn else None) for r in got if r.conv_id == 7)
    assert next(r.n_passages for r in got if r.conv_id == 8) == 2000
