"""One query for each operator, over whole tables with production parameters, and SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import bpe, containment, curriculum, licenses, pii, quality, quotes, simhash, tokencount, vafile
from sievewright.llm._batches import table

BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"
EVERY = 100


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(quotes.link(table(spark, sf_dir, "conversations")))


def op2_threshold_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_simhash_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.train(docs, labels))


def op5_pii_validated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_topk_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


def op7_curriculum_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.plan(table(spark, sf_dir, "documents"))


def op8_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_byte_bpe_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op10_token_counts_rank_synchronous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def base_license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of operator 8 that SQL states too: base phrases in whole texts."""
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of operator 5 that SQL states too: how many of each base kind whole texts hold."""
    return pii.detect(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quotation_links,
        op2_threshold_scaled_sketch,
        op3_simhash_bitsliced,
        op4_quality_random_indexing,
        op5_pii_validated_spans,
        op6_topk_va_file,
        op7_curriculum_mixture,
        op8_license_signatures,
        op9_byte_bpe_matrices,
        op10_token_counts_rank_synchronous,
        base_license_phrases,
        base_personal_data,
    )
}


def _license_sql() -> str:
    """Base phrases, word by word."""
    places = []
    for phrase, _ in licenses.BASE:
        own = phrase.split(" ")
        same = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(own))
        places.append(f"list_filter(range(1, len(w) - {len(own) - 2}), lambda i: {same})")
    found = ", ".join(f"{p} AS p{k}" for k, p in enumerate(places))
    every = " || ".join(f"p{k}" for k in range(len(places)))
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(licenses.BASE))
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
f AS (SELECT doc_id, w, {found} FROM t), e AS (SELECT *, {every} AS p FROM f)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word,
       array_to_string(list_sort(list_filter([{labels}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM e"""

#: White space as the quotation operator has it, and the text of a line without its quote marks.
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"

ORACLES = {
    "op1_quotation_links": f"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split_regex(coalesce(text, ''), '\\r?\\n') AS lines FROM conversations
), split AS (
  SELECT rid, conv_id, turn, i, regexp_extract(lines[i], '^[ \\t]*(?:>[ \\t]*)+') AS mark, lines[i] AS line
  FROM (SELECT rid, conv_id, turn, lines, unnest(range(1, len(lines) + 1)) AS i FROM m)
), leveled AS (
  SELECT rid, conv_id, turn, i, length(mark) - length(replace(mark, '>', '')) AS level, substr(line, length(mark) + 1) AS body FROM split
), kept AS (
  SELECT * FROM (SELECT *, lead(level, 1, 0) OVER (PARTITION BY rid ORDER BY i) AS below FROM leveled)
  WHERE NOT (level = 0 AND below > 0 AND regexp_matches(body, '(?i)(?:wrote|writes|schrieb|écrit|escribió)[ \\t]*:[ \\t]*$'))
), turns AS (
  SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY i) THEN 1 ELSE 0 END AS fresh FROM kept
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS island FROM turns
), passages AS (
  SELECT rid, conv_id, turn, island, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS text FROM islands GROUP BY ALL
), own AS (
  SELECT rid, conv_id, turn, trim(coalesce(string_agg(text, chr(10) ORDER BY island) FILTER (level = 0), ''), {_BLANKS}) AS text FROM passages GROUP BY ALL
), pieces AS (
  SELECT rid, conv_id, turn, island, level, text FROM passages WHERE level > 0 AND trim(text, {_BLANKS}) <> ''
  UNION ALL SELECT rid, conv_id, turn, 0, 0, text FROM own WHERE text <> ''
), raw AS (
  SELECT *, unnest(list_concat([text], string_split_regex(text, '\\n[ \\t]*\\n'))) AS unit, 1 AS least FROM pieces
  UNION ALL SELECT *, unnest(string_split(text, chr(10))) AS unit, CASE WHEN level = 0 THEN 1 ELSE 3 END AS least FROM pieces
  UNION ALL SELECT *, unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\n]+', '\\1' || chr(30), 'g'), chr(30))) AS unit, CASE WHEN level = 0 THEN 1 ELSE 3 END AS least FROM pieces
), units AS (
  SELECT DISTINCT rid, conv_id, turn, island, level, unit FROM (
    SELECT * REPLACE (trim(regexp_replace(lower(unit), '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')) AS unit) FROM raw)
  WHERE unit <> '' AND len(string_split(unit, ' ')) >= least
), originals AS (
  SELECT conv_id, unit, min(turn) AS origin FROM units WHERE level = 0 GROUP BY ALL
), linked AS (
  SELECT rid, conv_id, turn, island, level, max(origin) AS origin FROM units JOIN originals USING (conv_id, unit) WHERE level > 0 AND origin < turn GROUP BY ALL
), found AS (
  SELECT rid, conv_id, turn, count(*) AS n_linked, arg_max(origin, -1000000 * level + origin) AS reply_to FROM linked GROUP BY ALL
), climb AS (
  SELECT conv_id, turn, max(reply_to) AS up FROM found GROUP BY ALL
), climbing AS (
  SELECT conv_id, turn, up FROM climb
  UNION ALL SELECT a.conv_id, a.turn, b.up FROM climbing a JOIN climb b ON a.conv_id = b.conv_id AND a.up = b.turn
), tops AS (
  SELECT conv_id, turn, min(up) AS thread FROM climbing GROUP BY ALL
), places AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, thread ORDER BY turn) AS position FROM tops
), linked_rows AS (
  SELECT m.conv_id, m.turn, m.role, own.text AS clean_text, coalesce(found.n_linked, 0) AS n_linked, found.reply_to, coalesce(places.thread, m.turn) AS thread, coalesce(position, 0) AS position
  FROM m JOIN own ON own.rid = m.rid LEFT JOIN found ON found.rid = m.rid
  LEFT JOIN places ON places.conv_id = m.conv_id AND places.turn = m.turn AND found.rid IS NOT NULL
)
SELECT conv_id, thread, CAST(position // 512 AS BIGINT) AS part, count(*) AS n_turns, CAST(sum(n_linked) AS BIGINT) AS n_linked,
       string_agg(coalesce(CAST(turn AS VARCHAR), '-'), ',' ORDER BY position, turn NULLS FIRST, role NULLS FIRST, clean_text, reply_to NULLS FIRST) AS turns,
       string_agg(coalesce(CAST(reply_to AS VARCHAR), '-'), ',' ORDER BY position, turn NULLS FIRST, role NULLS FIRST, clean_text, reply_to NULLS FIRST) AS parents,
       string_agg('<' || coalesce(role, 'user') || '>' || clean_text, chr(10) ORDER BY position, turn NULLS FIRST, role NULLS FIRST, clean_text, reply_to NULLS FIRST) AS chat
FROM linked_rows GROUP BY conv_id, thread, part""",
    "op6_topk_va_file": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "base_license_phrases": _license_sql(),
    "base_personal_data": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (
  SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(text, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)') AS ip,
         list_transform(regexp_extract_all(text, '[0-9]([ -]?[0-9])+'), lambda c: regexp_replace(c, '[ -]', '', 'g')) AS card,
         list_transform(regexp_extract_all(text, '\\+[0-9][ ().0-9-]+[0-9]'), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g'))) AS phone FROM t)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email,
       CAST(len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0)) AS BIGINT) AS n_ip,
       CAST(len(list_filter(card, lambda d: length(d) BETWEEN 16 AND 19 AND
         list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[length(d) - i + 1] AS INTEGER) ELSE 2 * CAST(d[length(d) - i + 1] AS INTEGER) - CASE WHEN CAST(d[length(d) - i + 1] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS BIGINT) AS n_card,
       CAST(len(list_filter(phone, lambda n: n BETWEEN 8 AND 15)) AS BIGINT) AS n_phone FROM m""",
}
