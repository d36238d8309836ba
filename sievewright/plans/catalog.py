"""Named queries over the tables of a folder, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import constants as K
from sievewright.functions import text as T
from sievewright.functions.constants import Thresholds
from sievewright.functions.frames import cut, read_table, shared_folder
from sievewright.operators import decoding, dedup, gates, pack, select, tokens
from sievewright.plans import build, runs
from sievewright.plans import sql as S
from sievewright.sources import chunks, readers, state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Sizes that show several buffers and chunks on small tables too.
BUFFER, CHUNK, WINDOW = 16, 4096, 128
#: Words that a source may give, and kept rows that later ones are compared with.
BUDGET, STORED = 3_000_000_000, 500_000
SHORT = Thresholds(min_words=50)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages")


def sequenced(docs: DataFrame) -> DataFrame:
    """doc_id is the order of arrival, the number in a source's name its rank."""
    rank = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return docs.withColumns({"seq": F.col("doc_id"), "source_rank": rank})


# -- projections ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {S.word_count('text')} AS n_words FROM documents")
def word_count(spark, d):
    return documents(spark, d).select("doc_id", T.word_count("text").alias("n_words"))


@query(f"SELECT doc_id, {S.normalise('text')} AS normal FROM documents")
def normalize_text(spark, d):
    return documents(spark, d).select("doc_id", T.normalise("text").alias("normal"))


@query("SELECT doc_id, substr(text, 1, 2000) AS head FROM documents")
def truncate_prefix(spark, d):
    return documents(spark, d).select("doc_id", T.prefix("text", 2000).alias("head"))


@query(f"SELECT page_id, {S.clean('html')} AS clean_text FROM pages")
def html_strip(spark, d):
    return pages(spark, d).select("page_id", T.clean_markup("html").alias("clean_text"))


@query(f"SELECT page_id, {S.strip_blocks('html')} AS plain FROM pages")
def block_strip(spark, d):
    return pages(spark, d).select("page_id", T.strip_blocks("html").alias("plain"))


@query(f"SELECT page_id, {S.replaced('html', S.TAG, ' ')} AS plain FROM pages")
def tag_strip(spark, d):
    return pages(spark, d).select("page_id", T.strip_tags("html").alias("plain"))


@query(f"SELECT page_id, {S.strip_attributes('html')} AS plain FROM pages")
def attribute_strip(spark, d):
    return pages(spark, d).select("page_id", T.strip_attributes("html").alias("plain"))


@query(f"SELECT page_id, {S.tidy('html')} AS tidy FROM pages")
def whitespace_tidy(spark, d):
    return pages(spark, d).select("page_id", T.tidy("html").alias("tidy"))


@query(f"SELECT doc_id, {S.strip('text')} AS text FROM documents WHERE length({S.strip('text')}) > 0")
def arrived_documents(spark, d):
    return gates.arrived(documents(spark, d)).select("doc_id", "text")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {t}::BIGINT, '{f}', {k}::INTEGER)" for k, (n, t, f) in enumerate(K.SOURCE_CATALOG)) + ") v(source, target, text_field, source_rank)")
def source_catalog(spark, d):
    return state.catalog(spark)


@query(f"SELECT page_id, {S.decode_entities('html')} AS decoded FROM pages")
def entity_decode(spark, d):
    return pages(spark, d).select("page_id", T.decode_entities("html").alias("decoded"))


@query(f"SELECT page_id, {S.replaced('html', S.CSS, ' ')} AS plain FROM pages")
def css_strip(spark, d):
    return pages(spark, d).select("page_id", T.strip_css("html").alias("plain"))


_EMAIL = rf"\b[{S.W}.+-]+@[{S.W}-]+\.[{S.W}.-]*[{S.W}]"


@query(f"SELECT doc_id, {S.replaced(S.replaced('text', _EMAIL, '[EMAIL]'), chr(92) + 'b(?:' + chr(92) + '+62|62|0)8[1-9][0-9]{6,10}' + chr(92) + 'b', '[TELEPON]')} AS redacted FROM documents")
def redact_pii(spark, d):
    return documents(spark, d).select("doc_id", T.redact("text").alias("redacted"))


_RUNS = """
WITH w AS (SELECT {key}, unnest({words}) AS w, generate_subscripts({words}, 1) AS i FROM {table}),
     s AS (SELECT *, CASE WHEN w IS DISTINCT FROM lag(w) OVER (PARTITION BY {key} ORDER BY i) THEN 1 ELSE 0 END AS fresh FROM w),
     g AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY i) AS island FROM s),
     r AS (SELECT *, row_number() OVER (PARTITION BY {key}, island ORDER BY i) AS n FROM g),
     j AS (SELECT {key}, string_agg(w, ' ' ORDER BY i) AS capped FROM r WHERE n <= 3 GROUP BY ALL)
SELECT {keys}, coalesce(capped, text) AS capped FROM {table} LEFT JOIN j USING ({key})"""


@query(_RUNS.format(key="doc_id", keys="doc_id", table="documents", words=S.words("text")))
def repetition_cap(spark, d):
    return documents(spark, d).select("doc_id", T.cap_repeats("text").alias("capped"))


@query(f"SELECT conv_id, turn, {S.quoted(K.CHAT_TAGS[0])} || text || {S.quoted(K.CHAT_TAGS[1] + K.CHAT_TAGS[2])} AS prompt FROM conversations WHERE role = 'user'")
def chat_format(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").filter("role = 'user'")
    return turns.select("conv_id", "turn", T.format_prompt("text").alias("prompt"))


# -- measures and gates -----------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {S.markup_density('html')} AS density FROM pages")
def html_density(spark, d):
    return pages(spark, d).select("page_id", T.markup_density("html").alias("density"))


@query(f"SELECT page_id FROM pages WHERE {S.markup_density('html')} > 0.15")
def html_spam_gate(spark, d):
    return pages(spark, d).filter(T.markup_density("html") > 0.15).select("page_id")


@query(f"SELECT doc_id FROM documents WHERE {S.word_count('text')} BETWEEN 500 AND 10000")
def length_gate(spark, d):
    return documents(spark, d).filter(T.word_count("text").between(500, 10_000)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE length({S.strip('text')}) >= 100")
def min_chars_gate(spark, d):
    return documents(spark, d).filter(F.length(T.strip("text")) >= 100).select("doc_id")


def _symbols(table: str, key: str, text: str) -> str:
    return f"SELECT '{table}' AS origin, {key} AS id, {S.symbol_ratio(text)} AS ratio, {S.symbol_run(text)} AS run FROM {table}"


@query(_symbols("documents", "doc_id", "text") + " UNION ALL " + _symbols("pages", "page_id", "html"))
def symbol_spam(spark, d):
    part = lambda t, origin, key, c: t.select(F.lit(origin).alias("origin"), F.col(key).alias("id"), T.symbol_ratio(c).alias("ratio"), T.has_symbol_run(c).alias("run"))
    return part(documents(spark, d), "documents", "doc_id", "text").union(part(pages(spark, d), "pages", "page_id", "html"))


@query(f"SELECT doc_id, {S.density(S.boilerplate_hits('text'), S.word_count('text'))} AS density FROM documents")
def boilerplate_density(spark, d):
    return documents(spark, d).select("doc_id", T.boilerplate_density("text").alias("density"))


def _keyword(name: str, keywords: list[str]) -> None:
    def f(spark, d):
        docs = documents(spark, d).select("doc_id", F.lower("text").alias("low"))
        return docs.select("doc_id", T.keyword_density("low", keywords, T.word_count("low")).alias("density"))

    f.__name__ = name
    query(f"SELECT doc_id, {S.density(S.hits('low', keywords), S.word_count('low'))} AS density FROM (SELECT doc_id, lower(text) AS low FROM documents)")(f)


for _name, _keywords in (("profanity_density", K.PROFANITY), ("marketing_density", K.MARKETING), ("educational_score", K.EDUCATIONAL)):
    _keyword(_name, _keywords)


@query(f"SELECT page_id, {S.any_of('lower(html)', K.GAMBLING_ADULT)} AS gambling, {S.suspicious('lower(html)')} AS suspicious, {S.count('html', S.URL)} AS links FROM pages")
def link_gates(spark, d):
    return pages(spark, d).select("page_id", T.has_any(F.lower("html"), K.GAMBLING_ADULT).alias("gambling"), T.has_suspicious_domain(F.lower("html")).alias("suspicious"), T.link_count("html").alias("links"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({S.words('lower(text)')}) AS w FROM documents),
     c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
     m AS (SELECT doc_id, max(n) AS most, sum(n) AS n FROM c GROUP BY ALL)
SELECT doc_id, CAST(most AS DOUBLE) / n AS share FROM m WHERE n >= 10 AND most / n > 0.4""")
def dominant_word(spark, d):
    low = documents(spark, d).select("doc_id", F.lower("text").alias("low"))
    rows = low.select("doc_id", T.word_count("low").alias("n"), F.explode(F.array(T.dominant_share("low"))).alias("share"))
    return rows.filter("n >= 10 AND share > 0.4").select("doc_id", "share")


@query(f"""
WITH w AS (SELECT doc_id, unnest({S.words('lower(text)')}) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, min(word) AS word, any_value(n) AS n FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS most FROM c) WHERE n = most GROUP BY doc_id""")
def most_common_word(spark, d):
    counts = documents(spark, d).select("doc_id", F.explode(T.words(F.lower("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    best = counts.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "word")).alias("b"))
    return best.select("doc_id", F.col("b.word").alias("word"), (-F.col("b.m")).alias("n"))


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[.,?!]')")
def no_punctuation(spark, d):
    return documents(spark, d).filter(T.no_punctuation("text")).select("doc_id")


@query(f"SELECT doc_id, lang, lang IN ({', '.join(map(S.quoted, K.ALLOWED_LANGUAGES))}) AS allowed FROM documents")
def language_gate(spark, d):
    return documents(spark, d).select("doc_id", "lang", T.language_vote(F.array("lang")).alias("allowed"))


_MEASURES = "markup_density, n_words, symbol_ratio, symbol_run, boilerplate, gambling, suspicious, links, unpunctuated, profanity, marketing, educational"


@query(f"WITH {S.measured('documents', 'doc_id', 'text')} SELECT doc_id, {_MEASURES} FROM judged")
def measures(spark, d):
    return gates.with_measures(gates.arrived(documents(spark, d))).select("doc_id", *_MEASURES.split(", "))


@query(f"WITH {S.measured('documents', 'doc_id', 'text', 'lang,')} SELECT doc_id, {S.reason(50, language=True)} AS reason FROM judged")
def cascade(spark, d):
    limits = Thresholds(min_words=50, language="column")
    return gates.with_reason(gates.arrived(documents(spark, d)), "text", limits).select("doc_id", "reason")


#: A toy detector, by counts of marker words: what a real one would be given and asked for.
_MARKERS = {"de": "und", "en": "and", "es": "y", "fr": "et"}


def toy_detector(samples: list[str]) -> list[str | None]:
    """The language whose marker word stands in a sample most often, the first of them on ties; None without any."""
    counts = [[(-s.lower().split(" ").count(w), name) for name, w in _MARKERS.items()] for s in samples]
    return [min(c)[1] if min(c)[0] else None for c in counts]


def _toy_sql() -> str:
    count = lambda w: f"len(list_filter(string_split(lower(s), ' '), lambda w: w = '{w}'))"
    best = f"greatest({', '.join(map(count, _MARKERS.values()))})"
    return f"CASE WHEN {best} = 0 THEN NULL {' '.join(f'WHEN {count(w)} = {best} THEN {S.quoted(name)}' for name, w in sorted(_MARKERS.items()))} END"


@query(f"""WITH {S.measured('documents', 'doc_id', 'text')},
samples AS (SELECT doc_id, unnest(list_filter(list_transform([0.15, 0.5, 0.85], lambda f: substr(clean_text, CAST(floor(length(clean_text) * CAST(f AS DOUBLE)) AS BIGINT) + 1, 2000)), lambda s: length(s) >= 200)) AS s FROM judged WHERE length(clean_text) >= 800),
votes AS (SELECT doc_id, count(v) AS n, count(*) FILTER (v IN ({', '.join(map(S.quoted, K.ALLOWED_LANGUAGES))})) AS good FROM (SELECT doc_id, {_toy_sql()} AS v FROM samples) GROUP BY ALL)
SELECT doc_id, coalesce(CASE WHEN {S.reason(50)} IS NOT NULL THEN {S.reason(50)} WHEN n > 0 AND 2 * good < n THEN 'bahasa_tidak_diizinkan' END) AS reason FROM judged LEFT JOIN votes USING (doc_id)""")
def cascade_detected(spark, d):
    """The cascade with a detector of languages."""
    limits = Thresholds(min_words=50, language="detect")
    return gates.with_reason(gates.arrived(documents(spark, d)), "text", limits, toy_detector).select("doc_id", "reason")


@query(f"""WITH {S.measured('documents', 'doc_id', 'text')}, r AS (SELECT *, {S.reason(50)} AS reason FROM judged)
SELECT doc_id, reason, CASE reason WHEN 'html_css_spam' THEN markup_density WHEN 'panjang_invalid' THEN n_words WHEN 'symbol_spam' THEN symbol_ratio WHEN 'boilerplate' THEN boilerplate
  WHEN 'profanity' THEN profanity WHEN 'marketing_spam' THEN marketing END AS measure FROM r WHERE reason IS NOT NULL""")
def reject_measures(spark, d):
    """Rejected documents with the measure that a reason goes by, where it goes by one."""
    judged = gates.with_reason(gates.arrived(documents(spark, d)), "text", SHORT).filter(F.col("reason").isNotNull())
    return judged.select("doc_id", "reason", gates.measure().alias("measure"))


@query(f"WITH {S.measured('pages', 'page_id', 'html')} SELECT page_id, {S.reason(50)} AS reason FROM judged")
def cascade_pages(spark, d):
    return gates.with_reason(gates.arrived(pages(spark, d), "html"), "html", SHORT).select("page_id", "reason")


@query(f"WITH {S.measured('documents', 'doc_id', 'text')}, r AS (SELECT {S.reason()} AS reason FROM judged) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL")
def reject_reasons(spark, d):
    return gates.histogram(gates.with_reason(gates.arrived(documents(spark, d))))


@query(f"""WITH {S.measured('documents', 'doc_id', 'text')}, r AS (SELECT {S.reason(50)} AS reason FROM judged)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL ORDER BY n DESC, reason LIMIT 3""")
def top_reject_reasons(spark, d):
    return gates.histogram(gates.with_reason(gates.arrived(documents(spark, d)), "text", SHORT), 3)


@query("""SELECT doc_id, CASE WHEN length(text) < 800 THEN CAST([] AS VARCHAR[]) ELSE list_filter(list_transform([0.15, 0.5, 0.85], lambda f: substr(text, CAST(floor(length(text) * CAST(f AS DOUBLE)) AS BIGINT) + 1, 2000)), lambda s: length(s) >= 200) END AS samples FROM documents""")
def language_samples(spark, d):
    return documents(spark, d).select("doc_id", T.language_samples("text").alias("samples"))


@query(f"""WITH {S.measured('documents', 'doc_id', 'text')}, r AS (SELECT {S.reason(50)} AS reason FROM judged)
SELECT (SELECT count(*) FROM documents) AS seen, count(*) FILTER (reason IS NULL) AS kept, count(reason) AS rejected,
       CAST(count(*) FILTER (reason IS NULL) AS DOUBLE) / (SELECT count(*) FROM documents) * 100 AS kept_percent FROM r""")
def filter_funnel(spark, d):
    docs = documents(spark, d)
    return gates.funnel(docs, gates.with_reason(gates.arrived(docs), "text", SHORT))


# -- duplicates -------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({S.normalise('text')}) AS exact_hash FROM documents")
def exact_hash(spark, d):
    return documents(spark, d).select("doc_id", dedup.exact_hash("text").alias("exact_hash"))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {S.normalise('text')} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedup(spark, d):
    return dedup.exact_duplicates(documents(spark, d), "text", ["doc_id"]).filter(~F.col("duplicate")).select("doc_id")


_SHINGLES = f"""
words AS (SELECT doc_id, {S.words(S.normalise('text'))} AS w FROM documents),
quoted AS (SELECT doc_id, list_transform(w, lambda x: CASE WHEN contains(x, '''') AND NOT contains(x, '"') THEN '"' || replace(x, chr(92), chr(92) || chr(92)) || '"'
  ELSE '''' || replace(replace(x, chr(92), chr(92) || chr(92)), '''', chr(92) || '''') || '''' END) AS w FROM words),
shingled AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN ['(' || array_to_string(w, ', ') || CASE WHEN len(w) = 1 THEN ',)' ELSE ')' END]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: '(' || array_to_string(w[i:i + 4], ', ') || ')')) END AS s FROM quoted),
signed AS (SELECT doc_id, list_transform(range(0, 32), lambda k: list_min(list_transform(s, lambda x: md5(CAST(k AS VARCHAR) || '_' || x)))) AS signature FROM shingled)"""
_NEAR = """
firsts AS (SELECT signature, min(doc_id) AS id FROM signed GROUP BY ALL),
slots AS (SELECT id, unnest(range(0, 32)) AS k, unnest(signature) AS h FROM firsts),
pairs AS (SELECT x.id AS a, y.id AS b, CAST(count(*) AS INTEGER) AS agree FROM slots x JOIN slots y ON x.k = y.k AND x.h = y.h AND x.id < y.id GROUP BY ALL HAVING count(*) >= 28)"""


@query(f"WITH {_SHINGLES} SELECT doc_id, CAST(len(s) AS INTEGER) AS n FROM shingled")
def shingle_count(spark, d):
    return documents(spark, d).select("doc_id", dedup.shingle_count("text").alias("n"))


@query(f"WITH {_SHINGLES} SELECT doc_id, array_to_string(signature, ' ') AS signature FROM signed")
def minhash_signature(spark, d):
    return dedup.signed(documents(spark, d).select("doc_id", "text")).select("doc_id", F.array_join("signature", " ").alias("signature"))


@query()
def near_dedup_fast(spark, d):
    """near_dedup_greedy with minimum hashes by XXH64, which SQL elsewhere doesn't have."""
    return dedup.deduplicate(documents(spark, d).select("doc_id", "text"), "text", fast=True).select("doc_id", "dup_reason")


@query(f"WITH {_SHINGLES}, {_NEAR} SELECT a, b, agree FROM pairs")
def near_dup_pairs(spark, d):
    signed = cut(dedup.signed(documents(spark, d).select("doc_id", "text")))
    return dedup.near_pairs(cut(signed.groupBy("signature").agg(F.min("doc_id").alias("doc_id"))))


@query(f"WITH {_SHINGLES}, firsts AS (SELECT signature, min(doc_id) AS id FROM signed GROUP BY ALL) SELECT doc_id, id AS representative FROM signed JOIN firsts USING (signature)")
def near_dup_members(spark, d):
    """Whom near_dup_pairs speaks for: rows that aren't their own representative agree with it in all slots."""
    return dedup.members(dedup.signed(documents(spark, d).select("doc_id", "text")))


_GREEDY = f"""
WITH RECURSIVE {_SHINGLES}, {_NEAR},
exact AS (SELECT doc_id, row_number() OVER (PARTITION BY {S.normalise('text')} ORDER BY doc_id) AS n FROM documents),
late AS (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM pairs GROUP BY b),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone
  UNION ALL
  SELECT late.i, CASE WHEN len(list_filter(earlier, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, b) ELSE gone END
  FROM walk JOIN late ON late.i = walk.i + 1
), gone AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM walk ORDER BY i DESC LIMIT 1))
SELECT doc_id, CASE WHEN n > 1 THEN 'exact_duplicate' WHEN signed.doc_id <> firsts.id OR firsts.id IN (SELECT id FROM gone) THEN 'near_duplicate' END AS dup_reason
FROM signed JOIN firsts USING (signature) JOIN exact USING (doc_id)"""


@query(_GREEDY)
def near_dedup_greedy(spark, d):
    return dedup.deduplicate(documents(spark, d).select("doc_id", "text"), "text").select("doc_id", "dup_reason")


@query(_GREEDY)
def near_dedup_across_sources(spark, d):
    """The same in two turns: what the first half leaves as state is what the second half is held against."""
    docs = cut(documents(spark, d).select("doc_id", F.col("doc_id").alias("seq"), "text"))
    middle = docs.agg((F.min("doc_id") + F.max("doc_id")) / 2).first()[0]
    exact, signatures = spark.createDataFrame([], build.EXACT), spark.createDataFrame([], build.SIGNATURES)
    first = cut(build.new_documents(docs.filter(F.col("doc_id") <= middle), exact, signatures, "text"))
    kept = first.filter(F.col("dup_reason").isNull()).select("id", "signature")
    second = build.new_documents(docs.filter(F.col("doc_id") > middle), first.select("exact_hash"), kept, "text")
    return first.select("doc_id", "dup_reason").union(second.select("doc_id", "dup_reason"))


def capped_sql(most: int) -> str:
    """A walk over the rows that have an earlier near one. A kept row is stored if it is among the first `most` kept ones."""
    return f"""
WITH RECURSIVE {_SHINGLES}, {_NEAR},
ranked AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM firsts),
late AS (SELECT b, list({{'id': a, 'place': r.place}}) AS earlier, row_number() OVER (ORDER BY b) AS i FROM pairs JOIN ranked r ON r.id = a GROUP BY b),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone
  UNION ALL
  SELECT late.i, CASE WHEN len(list_filter(earlier, lambda x: NOT list_contains(gone, x.id) AND x.place - len(list_filter(gone, lambda g: g < x.id)) <= {most})) > 0 THEN list_append(gone, b) ELSE gone END
  FROM walk JOIN late ON late.i = walk.i + 1
), gone AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM walk ORDER BY i DESC LIMIT 1)),
last AS (SELECT coalesce((SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS k FROM firsts WHERE id NOT IN (SELECT id FROM gone)) WHERE k = {most}), 9223372036854775807) AS id)
SELECT doc_id, firsts.id IN (SELECT id FROM gone) OR (doc_id <> firsts.id AND firsts.id <= last.id) AS near_duplicate
FROM signed JOIN firsts USING (signature) CROSS JOIN last"""


@query(capped_sql(STORED))
def near_dedup_capped(spark, d):
    """Only so many kept rows, the first ones, are compared with."""
    return dedup.near_duplicates(documents(spark, d), "text", most=STORED)


# -- order, budgets, chunks -------------------------------------------------------------------------------------------

_ORDERED = f"""
scored AS (SELECT doc_id, source, {S.density(S.hits('lower(text)', K.EDUCATIONAL), S.word_count('text'))} AS score, CAST({S.word_count('text')} AS BIGINT) AS n_tokens FROM documents),
buffered AS (SELECT *, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // {BUFFER} AS BIGINT) AS buffer FROM scored),
ordered AS (SELECT *, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY buffer, score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM buffered)"""


def _ordered(spark, d) -> DataFrame:
    docs = sequenced(documents(spark, d)).withColumn("n_tokens", T.word_count("text").cast("bigint"))
    scored = docs.select("doc_id", "seq", "source", "source_rank", "n_tokens", T.keyword_density(F.lower("text"), K.EDUCATIONAL, F.col("n_tokens")).alias("score"))
    return select.emitted(cut(scored), "score", "n_tokens", BUFFER)


@query(f"WITH {_ORDERED} SELECT doc_id, source, buffer, score, before FROM ordered")
def buffer_sort(spark, d):
    return _ordered(spark, d).select("doc_id", "source", "buffer", "score", "before")


@query(f"WITH {_ORDERED} SELECT doc_id, source, before, n_tokens FROM ordered WHERE before < {BUDGET}")
def token_budget(spark, d):
    return select.within_budget(_ordered(spark, d), F.lit(BUDGET)).select("doc_id", "source", "before", "n_tokens")


@query(f"""
SELECT source, CAST(20000 AS BIGINT) AS target, CAST(greatest(0, 20000 - sum({S.word_count('text')})) AS BIGINT) AS remaining, sum({S.word_count('text')}) >= 20000 AS complete
FROM documents GROUP BY source""")
def source_budget(spark, d):
    done = documents(spark, d).groupBy("source").agg(F.sum(T.word_count("text")).alias("tokens"))
    return select.remaining(done.select("source", F.lit(20_000).cast("bigint").alias("target")), done)


def caps_sql(caps: list[tuple], chars: int) -> str:
    parts, carried = [], ["SELECT 0 AS n"]
    for k, (rows, least, keep, share) in enumerate(caps):
        piece = "text" if keep is None else f"substr(text, 1, {keep})"
        before = " UNION ALL ".join(f"SELECT coalesce(sum(length(piece)), 0) AS n FROM c{j}" for j in range(k)) or carried[0]
        parts.append(f"""r{k} AS (SELECT doc_id, {k} AS source_rank, {piece} AS piece, CAST(coalesce(sum(length({piece})) OVER w, 0) AS BIGINT) AS chars_before, count(*) OVER w AS rows_before
  FROM documents WHERE source = 'src{k}' AND length(text) >= {least} WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c{k} AS (SELECT * FROM r{k} WHERE rows_before = 0 OR (rows_before < {rows} AND chars_before + (SELECT sum(n) FROM ({before})) < {chars} * {share}))""")
    union = " UNION ALL ".join(f"SELECT doc_id, source_rank, CAST(length(piece) AS INTEGER) AS n_chars, chars_before FROM c{k}" for k in range(len(caps)))
    return f"WITH {', '.join(parts)} {union}"


def capped(spark, d, caps: list[tuple], chars: int) -> DataFrame:
    return select.capped_corpus(sequenced(documents(spark, d)), caps, chars)


@query(caps_sql(K.CORPUS_CAPS, K.CORPUS_CHARS))
def corpus_caps(spark, d):
    return capped(spark, d, K.CORPUS_CAPS, K.CORPUS_CHARS).select("doc_id", "source_rank", F.length("piece").alias("n_chars"), "chars_before")


@query(f"""WITH c AS (SELECT text, regexp_extract(source, '(\\d+)$', 1) AS k FROM documents),
p AS (SELECT CASE k WHEN '0' THEN text WHEN '1' THEN substr(text, 1, 2000) WHEN '2' THEN substr(text, 1, 1000) ELSE substr(text, 1, 1500) END AS piece FROM c
      WHERE k IN ('0', '1', '2', '3') AND length(text) >= CASE k WHEN '2' THEN 100 ELSE 50 END)
SELECT line, count(*) AS n FROM (SELECT unnest(string_split_regex(piece, '\\r\\n|\\r|\\n')) AS line FROM p) GROUP BY line""")
def corpus_lines(spark, d):
    """The corpus as it is written for a tokenizer, read back by the line."""
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    readers.write_corpus(capped(spark, d, K.CORPUS_CAPS, K.CORPUS_CHARS), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


#: Words as tokens, each its length, and the chunk and place in it of each.
_TOKENS = f"""{_ORDERED}, totals AS (SELECT source, sum(n_tokens) AS n, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS source_rank FROM scored GROUP BY ALL),
firsts AS (SELECT source, CAST(coalesce(sum(ceil(n / {CHUNK})) OVER (ORDER BY source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, n FROM totals),
listed AS (SELECT o.doc_id, firsts.first, o.before, {S.words('text')} AS w FROM ordered o JOIN firsts USING (source) JOIN documents d ON d.doc_id = o.doc_id),
each AS (SELECT doc_id, first, unnest(w) AS word, before + generate_subscripts(w, 1) - 1 AS spot FROM listed),
tokens AS (SELECT doc_id, word, CAST(length(word) AS INTEGER) AS token, first + spot // {CHUNK} AS chunk_id, spot % {CHUNK} AS place FROM each)"""


def _parts(spark, d, token=F.length) -> DataFrame:
    """Words as tokens, each its length, as parts of chunks."""
    texts = documents(spark, d).select(F.col("doc_id").alias("__d"), F.transform(T.words("text"), token).alias("tokens"))
    rows = _ordered(spark, d).join(texts, F.col("doc_id") == F.col("__d"))
    return pack.chunk_parts(rows, CHUNK, count="n_tokens")


_SIZES = f"SELECT chunk_id, count(*) AS n_tokens FROM tokens GROUP BY ALL"


@query(f"WITH {_TOKENS} SELECT chunk_id, count(*) AS n_tokens, chunk_id // {K.SHARD_CHUNKS} AS shard FROM tokens GROUP BY ALL")
def chunk_pack_stats(spark, d):
    return pack.chunk_sizes(_parts(spark, d)).select("chunk_id", "n_tokens", pack.shard().alias("shard"))


@query(f"WITH {_TOKENS} SELECT chunk_id, doc_id, min(place) AS offset, string_agg(word, ' ' ORDER BY place) AS words FROM tokens GROUP BY chunk_id, doc_id")
def chunk_words(spark, d):
    """Token order: the words that each document gives to each chunk, and where they begin."""
    texts = documents(spark, d).select(F.col("doc_id").alias("__d"), T.words("text").alias("tokens"))
    rows = _ordered(spark, d).join(texts, F.col("doc_id") == F.col("__d"))
    return pack.chunk_parts(rows, CHUNK, keep=["doc_id"], count="n_tokens").select("chunk_id", "doc_id", "offset", F.array_join("tokens", " ").alias("words"))


def _written(spark, d, shard: int | None) -> str:
    """The chunks as files in a folder of their own."""
    path = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    chunks.write(_parts(spark, d), path.removeprefix("file:"), shard)
    return path


@query(f"WITH {_TOKENS} SELECT 'chunk_' || lpad(CAST(chunk_id AS VARCHAR), 4, '0') || '.bin' AS name, chunk_id, count(*) AS n_tokens FROM tokens GROUP BY ALL")
def chunk_files(spark, d):
    """Chunks written to one folder, as their files say."""
    path = _written(spark, d, None)
    return chunks.files(spark, path).select(F.regexp_extract("path", r"(?:chunks-[0-9a-f]+)/(.*)$", 1).alias("name"), "chunk_id", "n_tokens")


@query(f"WITH {_TOKENS} SELECT 'shard_' || lpad(CAST(chunk_id // 2 AS VARCHAR), 3, '0') || '/chunk_' || lpad(CAST(chunk_id AS VARCHAR), 4, '0') || '.bin' AS name, chunk_id, count(*) AS n_tokens FROM tokens GROUP BY ALL")
def chunk_files_sharded(spark, d):
    """The same in folders of two chunks each."""
    path = _written(spark, d, 2)
    return chunks.files(spark, path).select(F.regexp_extract("path", r"(?:chunks-[0-9a-f]+)/(.*)$", 1).alias("name"), "chunk_id", "n_tokens")


@query(f"WITH {_TOKENS}, m AS (SELECT max(chunk_id) AS last FROM tokens) SELECT chunk_id, count(*) AS n_tokens, CAST(sum(token * (place % 1009 + 1)) AS BIGINT) AS weighed, chunk_id > any_value(last) - 2 AS validation FROM tokens, m GROUP BY chunk_id")
def chunk_scan(spark, d):
    """Chunk files read back: every token with its place, by chunk; the last two are for validation."""
    parts = chunks.read(spark, _written(spark, d, None), part=1000)
    each = parts.select("chunk_id", "offset", F.posexplode("tokens").alias("k", "token"))
    sums = each.groupBy("chunk_id").agg(F.count("*").alias("n_tokens"), F.sum(F.col("token") * ((F.col("offset") + F.col("k")) % 1009 + 1)).cast("bigint").alias("weighed"))
    return pack.split_validation(sums)


@query(f"WITH {_TOKENS}, c AS ({_SIZES}) SELECT CAST(sum(n_tokens) AS BIGINT) AS tokens_done, count(*) AS next_chunk FROM c")
def chunk_resume(spark, d):
    return chunks.resume_point_frame(spark, _written(spark, d, 2)).select("tokens_done", "next_chunk")


@query(f"""
WITH {_ORDERED}, totals AS (SELECT source, sum(n_tokens) AS n FROM scored GROUP BY ALL), c AS (SELECT CAST(sum(ceil(n / {CHUNK})) AS BIGINT) AS n FROM totals)
SELECT CAST(id AS BIGINT) AS chunk_id, id >= n - 2 AS validation FROM (SELECT n, unnest(range(0, n)) AS id FROM c)""")
def train_val_split(spark, d):
    return pack.split_validation(pack.chunk_sizes(_parts(spark, d)).select("chunk_id"))


@query()
def windows(spark, d):
    made = cut(_parts(spark, d))
    return pack.windows(made, pack.draw_windows(cut(pack.chunk_sizes(made)), 256, WINDOW, seed=11), WINDOW)


@query(f"""WITH {_TOKENS}, sizes AS ({_SIZES}), draws AS (SELECT event_id AS draw, event_id % (SELECT count(*) FROM sizes) AS chunk_id, event_id * 7919 AS point FROM events),
placed AS (SELECT draw, chunk_id, CAST(point % (n_tokens - {WINDOW} - 1) AS BIGINT) AS start FROM draws JOIN sizes USING (chunk_id) WHERE n_tokens > {WINDOW} + 1),
lists AS (SELECT chunk_id, list(token ORDER BY place) AS t FROM tokens GROUP BY ALL)
SELECT draw, chunk_id, start, array_to_string(t[start + 1:start + {WINDOW}], ' ') AS x, array_to_string(t[start + 2:start + {WINDOW} + 1], ' ') AS y FROM placed JOIN lists USING (chunk_id)""")
def windows_given(spark, d):
    """Windows at given draws: a row of events is a draw."""
    made = cut(_parts(spark, d))
    sizes = cut(pack.chunk_sizes(made))
    n = sizes.count()
    draws = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("draw"), (F.col("event_id") % n).alias("chunk_id"), (F.col("event_id") * 7919).alias("point"))
    placed = draws.join(sizes.filter(F.col("n_tokens") > WINDOW + 1), "chunk_id").select("draw", "chunk_id", (F.col("point") % (F.col("n_tokens") - WINDOW - 1)).cast("bigint").alias("start"))
    out = pack.windows(made, placed, WINDOW)
    return out.select("draw", "chunk_id", "start", F.array_join(F.transform("x", lambda t: t.cast("string")), " ").alias("x"), F.array_join(F.transform("y", lambda t: t.cast("string")), " ").alias("y"))


@query(f"""WITH p AS (SELECT source, sum({S.word_count('text')}) AS n, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS k FROM documents GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM p)
SELECT source, CAST(n AS BIGINT) AS n_tokens, CAST(before AS BIGINT) AS before FROM b WHERE before < total / 2""")
def global_stop(spark, d):
    """Sources in turn until half of all words are there; the one that reaches it is the last."""
    sums = sequenced(documents(spark, d)).groupBy("source", "source_rank").agg(F.sum(T.word_count("text")).cast("bigint").alias("n_tokens"))
    return select.turns(sums, lambda total: total / 2).select("source", "n_tokens", "before")


@query(f"""WITH p AS (SELECT source, CAST(sum({S.word_count('text')}) AS BIGINT) AS n FROM documents GROUP BY ALL)
SELECT array_to_string(list(source ORDER BY source), ',') AS completed, CAST(count(*) AS INTEGER) AS chunk_idx, CAST(sum(n) AS BIGINT) AS total_tokens, array_to_string(list(source || '=' || n ORDER BY source), ',') AS per_source FROM p""")
def progress_round_trip(spark, d):
    """Progress of a build over all sources, saved and loaded again."""
    sums = {r.source: r.n for r in documents(spark, d).groupBy("source").agg(F.sum(T.word_count("text")).alias("n")).collect()}
    path = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}.json"
    state.save_progress(spark, path, state.Progress(sorted(sums), [], len(sums), sum(sums.values()), sums))
    made = state.progress_frame(spark, state.load_progress(spark, path))
    each = F.transform(F.array_sort(F.map_entries("tokens_per_source")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return made.select(F.array_join("completed_sources", ",").alias("completed"), "chunk_idx", "total_tokens", F.array_join(each, ",").alias("per_source"))


@query("SELECT event_id AS step, round(value, 6) AS train, CASE WHEN event_id % 4 = 0 THEN round(value / 2, 6) END AS val FROM events")
def loss_log(spark, d):
    """Losses appended to a log in two turns, read back."""
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("step"), F.col("value").alias("train"), F.when(F.col("event_id") % 4 == 0, F.col("value") / 2).alias("val"))
    path = f"{shared_folder(spark)}/losses-{uuid.uuid4().hex}"
    for half in (0, 1):
        runs.append_losses(rows.filter(F.col("step") % 2 == half), path)
    return runs.read_losses(spark, path)


@query("SELECT event_id AS step, event_id < 15000 AS immature FROM events")
def run_maturity(spark, d):
    return runs.with_maturity(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("step")))


@query("WITH p(name, layers, hidden, heads, kv_heads, vocab) AS (VALUES " + ", ".join(f"('{n}', {', '.join(f'{x}::BIGINT' for x in rest)})" for n, *rest in K.PRESETS) + ") SELECT name, hidden // heads AS head, heads // kv_heads AS shared FROM p WHERE hidden % heads = 0 AND heads % kv_heads = 0")
def checked_presets(spark, d):
    """Presets that pass the checks of their shape; one that doesn't fails the query."""
    ok = runs.checked(runs.presets(spark))
    return ok.select("name", F.floor(F.col("hidden") / F.col("heads")).cast("bigint").alias("head"), F.floor(F.col("heads") / F.col("kv_heads")).cast("bigint").alias("shared"))


_PIECE = "CASE p_size % 4 WHEN 0 THEN '<0x' || lpad(upper(to_hex(p_partkey % 256)), 2, '0') || '>' WHEN 1 THEN '<0x' || lower(to_hex(p_partkey)) || '>' WHEN 2 THEN p_type ELSE '<0xG' || p_size || '>' END"


@query(f"WITH p AS (SELECT p_partkey, {_PIECE} AS piece FROM part) SELECT p_partkey, piece, regexp_full_match(piece, '<0x[0-9A-Fa-f]{{2}}>') AS is_byte FROM p")
def byte_pieces(spark, d):
    """Which pieces stand for a byte; pieces are made of the parts' columns."""
    kind, key = F.col("p_size") % 4, F.col("p_partkey")
    byte = F.concat(F.lit("<0x"), F.lpad(F.upper(F.hex(key % 256)), 2, "0"), F.lit(">"))
    piece = F.when(kind == 0, byte).when(kind == 1, F.concat(F.lit("<0x"), F.lower(F.hex(key)), F.lit(">"))).when(kind == 2, F.col("p_type")).otherwise(F.concat(F.lit("<0xG"), F.col("p_size"), F.lit(">")))
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", piece.alias("piece"))
    return rows.select("p_partkey", "piece", tokens.is_byte_piece("piece").alias("is_byte"))


def _word_model(spark, d) -> bytes:
    """A model of the corpus that the caps allow, which is a sample of bounded size; its vocabulary suits small tables."""
    return tokens.train(capped(spark, d, K.CORPUS_CAPS, K.CORPUS_CHARS), "piece", vocab=2000)


@query()
def tokenize_counts(spark, d):
    model = _word_model(spark, d)
    coded = tokens.safe_decode(tokens.encode(documents(spark, d).select("doc_id", "text"), model).drop("text"), model)
    return coded.select("doc_id", F.size("tokens").alias("n_tokens"), F.length("decoded").alias("n_chars"))


@query()
def token_pieces(spark, d):
    """How often each piece stands in the encoded documents."""
    model = _word_model(spark, d)
    coded = tokens.pieces(tokens.encode(documents(spark, d).select("text"), model).select("tokens"), model)
    return coded.select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


# -- runs -------------------------------------------------------------------------------------------------------------


@query(
    "WITH p(name, layers, hidden, heads, kv_heads, vocab) AS (VALUES "
    + ", ".join(f"('{n}', {', '.join(f'{x}::BIGINT' for x in rest)})" for n, *rest in K.PRESETS)
    + """), i AS (SELECT *, (CAST(floor(hidden * 8 / 3) AS BIGINT) + 255) // 256 * 256 AS intermediate FROM p)
SELECT *, CAST(vocab * hidden + layers * (2 * hidden + hidden * heads * (hidden // heads) + 2 * hidden * kv_heads * (hidden // heads) + hidden * hidden + 3 * hidden * intermediate) + hidden AS BIGINT) AS parameters FROM i"""
)
def presets(spark, d):
    return runs.presets(spark)


@query("""SELECT step, round(CASE WHEN step < 200 THEN 3e-4 * (step + 1) / 200.0 ELSE 1e-5 + (3e-4 - 1e-5) * 0.5 * (1 + cos(pi() * ((step - 200) / 1800.0))) END, 12) AS rate
FROM (SELECT unnest(range(0, 2000)) AS step)""")
def lr_schedule(spark, d):
    return runs.learning_rates(spark, 3e-4, 1e-5, 200, 2000).select("step", F.round("rate", 12).alias("rate"))


@query("""WITH l AS (SELECT 'step_' || lpad(CAST(event_id AS VARCHAR), 7, '0') || CASE WHEN event_id % 7 = 0 THEN '_final' ELSE '' END AS name, value AS mtime FROM events)
SELECT name, mtime FROM (SELECT *, row_number() OVER (ORDER BY mtime DESC, name DESC) AS r FROM l WHERE NOT contains(name, '_final')) WHERE r > 2""")
def checkpoint_retention(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    name = F.concat(F.lit("step_"), F.lpad(F.col("event_id").cast("string"), 7, "0"), F.when(F.col("event_id") % 7 == 0, "_final").otherwise(""))
    return runs.expired(events.select(name.alias("name"), F.col("value").alias("mtime")))


@query("SELECT avg(train) AS train, avg(val) AS val FROM (SELECT value AS train, CASE WHEN event_id % 2 = 0 THEN value END AS val FROM events ORDER BY event_id DESC LIMIT 10)")
def mean_eval_loss(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return runs.mean_loss(events.select(F.col("event_id").alias("step"), F.col("value").alias("train"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("val")))


# -- decoding: a vector's components stand for the logits of a step ---------------------------------------------------


def _logits(spark, d) -> DataFrame:
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    return vectors.select(F.col("vec_id").alias("step"), F.posexplode("embedding").alias("token_id", "x")).select("step", "token_id", F.col("x").cast("double").alias("logit"))


_LOGITS = "l AS (SELECT vec_id AS step, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS token_id, CAST(unnest(embedding) AS DOUBLE) AS logit FROM embeddings)"


@query(f"WITH {_LOGITS} SELECT step, token_id, round(logit / 0.9, 12) AS logit FROM l QUALIFY rank() OVER (PARTITION BY step ORDER BY logit / 0.9 DESC) <= 10")
def top_k_logits(spark, d):
    return decoding.top_k(decoding.scaled(_logits(spark, d), 0.9), 10).withColumn("logit", F.round("logit", 12))


def _history(spark, d) -> DataFrame:
    """Tokens that a step has behind it: numbers made of its own."""
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("step"), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: ((F.col("vec_id") * 7 + k * k) % 11).cast("int")).alias("tokens"))


_HISTORY = "h AS (SELECT vec_id AS step, list_transform(range(0, 20), lambda k: CAST((vec_id * 7 + k * k) % 11 AS INTEGER)) AS tokens FROM embeddings)"


@query(f"""WITH {_LOGITS}, {_HISTORY}, c AS (SELECT step, token_id, count(*) AS n FROM (SELECT step, unnest(tokens) AS token_id FROM h) GROUP BY ALL)
SELECT step, token_id, round(CASE WHEN logit > 0 THEN logit / pow(1.6, coalesce(n, 0)) ELSE logit * pow(1.6, coalesce(n, 0)) END, 9) AS logit FROM l LEFT JOIN c USING (step, token_id)""")
def repetition_penalty(spark, d):
    history = _history(spark, d).select("step", F.explode("tokens").alias("token_id"))
    return decoding.penalised(_logits(spark, d), history, 1.6).select("step", "token_id", F.round("logit", 9).alias("logit"))


@query(f"""WITH {_HISTORY} SELECT DISTINCT step, tokens[i + 1] AS token_id FROM (SELECT *, unnest(range(1, len(tokens))) AS i FROM h) WHERE tokens[i] = tokens[len(tokens)]""")
def banned_ngrams(spark, d):
    return decoding.banned_tokens(_history(spark, d), 2)


@query(f"WITH {_LOGITS} SELECT step, token_id, round(exp(logit - max(logit) OVER (PARTITION BY step)) / sum(exp(logit - m)) OVER (PARTITION BY step), 9) AS probability FROM (SELECT *, max(logit) OVER (PARTITION BY step) AS m FROM l)")
def softmax(spark, d):
    return decoding.probabilities(_logits(spark, d)).select("step", "token_id", F.round("probability", 9).alias("probability"))


@query(f"""WITH {_LOGITS}, k AS (SELECT step, token_id, logit / 0.9 AS x FROM l QUALIFY rank() OVER (PARTITION BY step ORDER BY logit / 0.9 DESC) <= 50),
m AS (SELECT step, token_id, exp(x - max(x) OVER (PARTITION BY step)) AS e FROM k), p AS (SELECT step, token_id, e / sum(e) OVER (PARTITION BY step) AS q FROM m),
u AS (SELECT step, token_id, sum(q) OVER (PARTITION BY step ORDER BY token_id ROWS UNBOUNDED PRECEDING) AS upto, (step * 37 % 101 + 0.5) / 101 AS point FROM p)
SELECT step, coalesce(min(token_id) FILTER (upto > point), max(token_id)) AS token_id FROM u GROUP BY step""")
def sampled_tokens_given(spark, d):
    """Draws at given points of 0 to 1."""
    chances = decoding.probabilities(decoding.top_k(decoding.scaled(_logits(spark, d), 0.9), 50))
    return decoding.draw_at(chances, (F.col("step") * 37 % 101 + 0.5) / 101)


@query()
def sampled_tokens(spark, d):
    return decoding.draw(decoding.probabilities(decoding.top_k(decoding.scaled(_logits(spark, d), 0.9), 50)), seed=5)


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({S.words('text')}) AS word FROM documents) GROUP BY ALL")
def token_frequency(spark, d):
    return documents(spark, d).select(F.explode(T.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT source, count(*) AS n, CAST(sum({S.word_count('text')}) AS BIGINT) AS n_tokens FROM documents GROUP BY ALL")
def source_totals(spark, d):
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum(T.word_count("text")).alias("n_tokens"))
