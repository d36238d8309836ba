"""Chat formatting by quotation linking (operator 1). DataFrame functions only.

A line's quote level is the number of > in front of it. Neighbouring lines of one level are a passage; what stands at
level 0 is the message's own text, less a line that announces a quote ("... wrote:") right above one. Own texts and
passages are cut into units: the whole, its paragraphs, lines and sentences, normalised (lower case, white space to a
blank) and hashed. A quoted passage asks for itself and its paragraphs whatever their length, and for its lines and
sentences of at least LINE_WORDS words; a message has all its units. A hash links to its original: the first message of
the conversation that has it in its own text, if that is an earlier turn. A message replies to the latest original of
its passages of the lowest level that is linked (its parent), and belongs to the thread of that original.

conversations() has a row for each thread, its messages in reply order with the quotes gone: each turn follows the one
that it replies to. A thread of more than PART turns is given in parts of PART turns, numbered from 0, so that no row
and no task grows with a thread.

Originals are the minimum of a partial aggregation and unique by (conversation, hash), so a passage that everyone
quotes adds a row for each quote and no pairs; those that are asked for meet the quotes by shares of a conversation; threads are found by pointer doubling over messages that reply, with a
reliable checkpoint a round; places in a thread are running sums over buckets of turns.

Defined results: a null or empty text has an empty clean_text and no passages; messages with a null conv_id or turn
link to nothing; rows that repeat a conversation and turn are one message for links to them and share a place, and each
keeps what its own text quotes; a message without links starts a thread; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.frames import running_sum
from sievewright.llm._batches import cut, let

LINE_WORDS = 3
#: Shares of a conversation's messages that meet its originals in tasks of their own.
SALTS = 16
#: Turns of a thread that a row holds.
PART = 512
PREFIX = r"^[ \t]*(?:>[ \t]*)+"
ANNOUNCES = r"(?i)(?:wrote|writes|schrieb|écrit|escribió)[ \t]*:[ \t]*$"
WHITE = r"[ \t\n\r\x0B\f]+"


def _lines(text: Column) -> Column:
    """array<struct<level, body>> of a text's lines."""

    def one(line: Column) -> Column:
        prefix = F.regexp_extract(line, PREFIX, 0)
        return let(prefix, lambda p: F.struct((F.length(p) - F.length(F.replace(p, F.lit(">"), F.lit("")))).alias("level"), F.substring(line, F.length(p) + 1, F.length(line)).alias("body")))

    return F.transform(F.split(text, r"\r?\n"), one)


def _passages(lines: Column) -> Column:
    """array<struct<level, text>>: neighbouring lines of one level, announcements left out."""
    n = F.size(lines)
    level = lambda i: F.get(lines, i)["level"]
    announces = lambda i: (level(i) == 0) & F.coalesce(level(i + 1) > 0, F.lit(False)) & F.get(lines, i)["body"].rlike(ANNOUNCES)
    kept = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~announces(i)), lambda i: F.get(lines, i))

    def blocks(own: Column) -> Column:
        size = F.size(own)
        starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(own, i)["level"] != F.get(own, i - 1)["level"]))
        cutting = lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(size)), lambda a, b: F.struct(F.get(own, a)["level"].alias("level"), F.array_join(F.transform(F.slice(own, a + 1, b - a), lambda x: x["body"]), "\n").alias("text")))
        return F.when(size == 0, F.array().cast("array<struct<level:int,text:string>>")).otherwise(let(starts, cutting))

    return let(kept, blocks)


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), WHITE, " "))


def _units(text: Column, least: int) -> Column:
    """Hashes of the text and its paragraphs, and of its lines and sentences of at least so many words."""
    whole = F.filter(F.concat(F.array(text), F.split(text, r"\n[ \t]*\n")), lambda u: normalised(u) != "")
    sentences = F.split(F.regexp_replace(text, r"([.!?])[ \t\n]+", "$1\x1e"), "\x1e")
    fine = F.filter(F.concat(F.split(text, "\n"), sentences), lambda u: let(normalised(u), lambda n: (n != "") & (F.size(F.split(n, " ")) >= least)))
    return F.array_distinct(F.transform(F.concat(whole, fine), lambda u: F.xxhash64(normalised(u))))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text_key, clean_text, quotes array<struct<level, text>> of each row."""
    text = F.coalesce("text", F.lit(""))
    # Without a mark the whole text is one passage of level 0.
    plain = F.array(F.struct(F.lit(0).alias("level"), F.regexp_replace(text, r"\r\n", "\n").alias("text")))
    marked = F.contains(text, F.lit(">"))
    rows = messages.select("conv_id", "turn", "role", F.xxhash64(text).alias("text_key"), F.when(marked, let(let(text, _lines), _passages)).otherwise(plain).alias("p"))
    own = F.btrim(F.array_join(F.transform(F.filter("p", lambda x: x["level"] == 0), lambda x: x["text"]), "\n"), F.lit(" \t\n\r\x0b\x0c"))
    return rows.select("conv_id", "turn", "role", "text_key", own.alias("clean_text"), F.filter("p", lambda x: (x["level"] > 0) & (normalised(x["text"]) != "")).alias("quotes"))


def threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, thread for each (conv_id, turn, reply_to): what stands above all of them, by pointer doubling."""
    now = cut(replies.select("conv_id", "turn", F.col("reply_to").alias("thread")))
    while True:
        above = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("up"))
        moved = cut(now.join(above, (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t")), "left").select("conv_id", "turn", F.coalesce("up", "thread").alias("thread"), F.col("up").isNotNull().alias("moved")))
        if moved.filter("moved").isEmpty():
            return moved.drop("moved")
        now = moved.drop("moved")


def _salted(rows: DataFrame) -> DataFrame:
    """Each row once for each salt: what the messages of one conversation are dealt out to meet."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, clean_text, n_passages, n_linked, reply_to, thread, position, chat of each row.

    position counts the turns of the thread before the row's own.
    """
    parsed = parse(messages)
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    quoting = parse(messages.filter(F.contains("text", F.lit(">")))).filter(placed & (F.size("quotes") > 0)).select("conv_id", "turn", "text_key", F.posexplode("quotes").alias("place", "q")).distinct()
    asked = quoting.select("conv_id", "turn", "text_key", "place", F.col("q.level").alias("level"), F.explode(_units(F.col("q.text"), LINE_WORDS)).alias("hash"))
    # Only conversations in which someone quotes have anything to link.
    heard = parsed.filter(placed & (F.col("clean_text") != "")).withColumn("salt", F.pmod("turn", F.lit(SALTS)))
    heard = heard.join(_salted(quoting.select("conv_id").distinct()), ["conv_id", "salt"], "left_semi")
    have = heard.select("conv_id", "turn", F.explode(_units(F.col("clean_text"), 1)).alias("hash"))
    originals = have.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    hits = originals.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"])
    linked = asked.withColumn("salt", F.pmod("turn", F.lit(SALTS))).join(_salted(hits), ["conv_id", "hash", "salt"]).filter("origin < turn")
    per_passage = linked.groupBy("conv_id", "turn", "text_key", "place", "level").agg(F.max("origin").alias("origin"))
    found = cut(per_passage.groupBy("conv_id", "turn", "text_key").agg(F.count("*").alias("n_linked"), F.max(F.struct((-F.col("level")).alias("l"), "origin"))["origin"].alias("reply_to")))
    replies = found.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("reply_to"))
    roots = cut(running_sum(threads(replies), "ahead", F.lit(1), ["conv_id", "thread"], F.floor(F.col("turn") / PART), ["turn"]))
    per_row = found.join(roots, ["conv_id", "turn"]).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("text_key").alias("k"), "n_linked", "reply_to", "thread", (F.col("ahead") + 1).alias("position"))
    rows = parsed.join(per_row, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("text_key") == F.col("k")), "left")
    return rows.select(
        "conv_id", "turn", "role", "clean_text", F.size("quotes").cast("bigint").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "reply_to",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("position", F.lit(0)).cast("bigint").alias("position"),
        F.concat(F.lit("<"), F.coalesce("role", F.lit("user")), F.lit(">"), F.col("clean_text")).alias("chat"),
    )


def conversations(linked: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, thread, part, n_turns, n_linked, turns, parents, chat of each thread; linked: link().

    turns and parents are numbers joined by commas, - for none; chat has a tagged turn after the other.
    """
    own = F.struct("position", "turn", "role", "clean_text", "reply_to", "chat")
    rows = linked.groupBy("conv_id", "thread", F.floor(F.col("position") / part).alias("part"))
    held = rows.agg(F.count("*").alias("n_turns"), F.sum("n_linked").alias("n_linked"), F.array_sort(F.collect_list(own)).alias("m"))
    joined = lambda c: F.array_join(F.transform("m", lambda m: F.coalesce(m[c].cast("string"), F.lit("-"))), ",")
    return held.select("conv_id", "thread", "part", "n_turns", "n_linked", joined("turn").alias("turns"), joined("reply_to").alias("parents"), F.array_join(F.transform("m", lambda m: m["chat"]), "\n").alias("chat"))
