"""Registered queries over the corpus tables, each with its DuckDB twin where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import constants as C
from corpusmill.functions import text as X
from corpusmill.functions import udfs
from corpusmill.operators import corpus, evaluation, retrieval
from corpusmill.sources.tables import spread, table, values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Literal keyword queries of the ranking queries.
ASKED = "(1, 'the thing and thation of'), (2, 'erent and the reader'), (3, 'ertion tion the ing'), (4, 'nder thand and his store'), (5, 'les de la mentaire'), (6, 'und der schlicheit'), (7, 'they were heat there'), (8, 'ha')"
STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)
WORD_SQL = C.WORD.replace("'", "''")


def tokens_sql(text: str) -> str:
    """The search analyser in DuckDB SQL: folding, broken words, citation spellings, then words and, after them, subsections, citations and amounts."""
    t = f"replace(replace(lower({text}), 'ß', 'ss'), chr(173), '')"
    t = f"replace(replace(regexp_replace({t}, '([a-z])-[ \\t]*\\r?\\n[ \\t]*([a-z])', '\\1\\2', 'g'), '§§', ' sections '), '§', ' section ')"
    t = f"regexp_replace({t}, '\\btitle\\s+(\\d+)\\s+of\\s+the\\s+united\\s+states\\s+code\\b', '\\1 usc', 'g')"
    for pattern, plain in udfs.ALIASES:
        ahead = r"(?=\W|$)"
        t = f"regexp_replace({t}, '{pattern.replace(ahead, r'(\W|$)')}', '{plain + (r'\1' if ahead in pattern else '')}', 'g')"
    t = f"regexp_replace({t}, '(\\d),(\\d{{3}})(\\D|$)', '\\1\\2\\3', 'g')"
    cite = udfs.CITATION
    return f"""(WITH n AS (SELECT {t} AS t) SELECT list_concat(regexp_extract_all(t, '({WORD_SQL})', 1), list_concat(
      list_transform(regexp_extract_all(t, '{udfs.SUBSECTION}', 0), lambda m: regexp_replace(m, '\\s+', '', 'g')), list_concat(
      list_transform(regexp_extract_all(t, '{cite}', 0), lambda m: regexp_replace(m, '\\s+', '_', 'g')),
      list_transform(regexp_extract_all(t, '\\$\\s*(\\d+(?:\\.\\d+)?)', 1), lambda m: 'usd_' || replace(m, '.', '_'))))) FROM n)"""


TOKENS_SQL = tokens_sql("text")


def asked(spark: SparkSession) -> DataFrame:
    return values(spark, ASKED, "query_id, query")


# --- distributions and scalar rules over documents


@query("""
WITH w AS (SELECT len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT CASE WHEN n < 50 THEN '0-50' WHEN n < 200 THEN '50-200' WHEN n < 500 THEN '200-500' WHEN n < 1000 THEN '500-1000' ELSE '1000+' END AS bucket,
       count(*) AS n_docs, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(median(n), 6) AS middle
FROM w GROUP BY 1""")
def doc_length_buckets(spark, sf_dir):
    bucket = F.when(F.col("n") < 50, "0-50").when(F.col("n") < 200, "50-200").when(F.col("n") < 500, "200-500").when(F.col("n") < 1000, "500-1000").otherwise("1000+")
    own = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(X.word_count(F.col("text")).alias("n")).select("n", bucket.alias("bucket"))
    middle = corpus.exact_percentiles(own, "bucket", "n", [0.5]).select("bucket", F.round(F.col("l0").cast("double"), 6).alias("middle"))
    return own.groupBy("bucket").agg(F.count("*").alias("n_docs"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean")).join(middle, "bucket")


@query("SELECT lang, source, count(*) AS n_docs, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY lang, source")
def lang_source_distribution(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n_docs"))
    total = counts.agg(F.sum("n_docs").alias("all_docs"))
    return counts.join(F.broadcast(total), F.lit(True)).select("lang", "source", "n_docs", F.round(100.0 * F.col("n_docs") / F.col("all_docs"), 6).alias("percent"))


@query("SELECT source, count(*) AS n_docs, arg_min(lang, doc_id) AS first_lang, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source")
def source_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.min_by("lang", "doc_id").alias("first_lang"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("""
WITH v AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN left(text, 400) || repeat(chr(65533), (doc_id % 11)::INT) WHEN doc_id % 5 = 1 THEN left(text, 400) || repeat(chr(57344), (doc_id % 11)::INT) ELSE text END AS t FROM documents)
SELECT doc_id, length(regexp_replace(t, '\\s', '', 'g')) >= 40 AND (length(t) - length(replace(t, chr(65533), ''))) / greatest(length(t), 1) <= 0.02
       AND (length(t) - length(replace(replace(t, chr(65533), ''), chr(57344), ''))) / greatest(length(t), 1) <= 0.02 AS usable FROM v""")
def page_text_usability(spark, sf_dir):
    marks = lambda c: F.concat(F.left("text", F.lit(400)), F.repeat(F.lit(c), (F.col("doc_id") % 11).cast("int")))
    t = F.when(F.col("doc_id") % 5 == 0, marks("\ufffd")).when(F.col("doc_id") % 5 == 1, marks("\ue000")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("text")).select("doc_id", X.usable_page(F.col("text")).alias("usable"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) > 20000 THEN 'long' WHEN length(text) < 40 THEN 'short' END AS reason FROM documents")
def audit_frame(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), F.when(n == 0, "empty").when(n > 20000, "long").when(n < 40, "short").alias("reason"))


@query("""
SELECT sha256(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS group_key, count(*) AS n_docs, min(doc_id) AS first_doc_id
FROM documents WHERE regexp_replace(lower(text), '[^a-z0-9]', '', 'g') <> '' GROUP BY 1 HAVING count(*) > 1""")
def exact_dup_groups(spark, sf_dir):
    return corpus.duplicate_groups(table(spark, sf_dir, "documents"), X.fingerprint(F.col("text")))


@query("""
WITH k AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k FROM documents)
SELECT sha256(k) AS group_key, count(*) AS n_docs, min(doc_id) AS first_doc_id FROM k WHERE k <> '' GROUP BY 1 HAVING count(*) > 1""")
def canonical_dup_groups(spark, sf_dir):
    return corpus.duplicate_groups(table(spark, sf_dir, "documents"), X.canonical(F.col("text")))


@query()
def trigram_jaccard_pairs(spark, sf_dir):
    return corpus.similar_pairs(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "ord"), 0.95)


@query()
def near_dup_kept(spark, sf_dir):
    return corpus.first_kept(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "ord"), 0.95)


@query()
def nearby_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "n_chars", udfs.nearby_line_dedup("text").alias("t")).select("doc_id", (F.col("n_chars") - F.length("t")).alias("removed_chars"), F.sha2("t", 256).alias("sha256"))


@query(f"SELECT doc_id, length(regexp_replace(text, '(?m){C.PAGE_NUMBER_LINE}', '', 'g')) AS n_left FROM documents")
def page_number_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.strip_page_numbers(F.col("text"))).alias("n_left"))


#: What is set before the documents, by doc_id, so that every kind of text occurs: lead, headings, and the headings as cleaned.
VARIANTS = [
    ("", None, []),
    ("Notes and Questions\n", None, []),
    ("", ["PROBLEM 1 - 2"], ["PROBLEM 1 - 2"]),
    ("", ["Chapter 3 - Introduction"], ["Chapter 3 - Introduction"]),
    ("", ["Chapter 3 - Pleading", "§ 3.01 Introduction p. 12"], ["Chapter 3 - Pleading", "§ 3.01 Introduction"]),
    ("Argued in May. Decided in June. Justice X, dissenting.\n", None, []),
    ("Justice Y wrote; it was affirmed.\n", ["Roe v. Wade"], ["Roe v. Wade"]),
    ("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n", None, []),
    ("Rule 7 says so. ", ["Analysis **"], ["Analysis **"]),
    ("", ["Model Rule 1.6 ........ 44"], ["Model Rule 1.6"]),
    ("Rule 12 provides that ", None, []),
    ("1. Id. at 3. See supra note 2, cf. infra.\n2. See e.g., Compare x.\n", None, []),
    ("", ["Table  of Cases"], ["Table of Cases"]),
    ("Copyright © 2020 X.\nAll rights reserved.\n", None, []),
    ("Justice Y wrote; it was affirmed.\n", ["Roe v. Wade", "Notes and Questions"], ["Roe v. Wade", "Notes and Questions"]),
    ("notes & question\n", ["Chapter 4 - Introduction", "§ 3.01 Introduction"], ["Chapter 4 - Introduction", "§ 3.01 Introduction"]),
    ("See so. a\t\tb\nc\t\td\ne\t\tf\n", ["Part I"], ["Part I"]),
]


def _literal(x) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return "NULL::VARCHAR[]" if x is None else quoted(x) if isinstance(x, str) else f"[{', '.join(map(quoted, x))}]::VARCHAR[]"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


VARIANTS_SQL = ", ".join(f"({i}, {_literal(lead)}, {_literal(raw)}, {_literal(clean)})" for i, (lead, raw, clean) in enumerate(VARIANTS))


@query(f"""
WITH v AS (SELECT * FROM (VALUES {VARIANTS_SQL}) AS v(k, lead, raw, h)),
d AS (SELECT doc_id, lead || text AS text, raw, h, h[len(h)] AS leaf FROM documents JOIN v ON k = doc_id % {len(VARIANTS)}),
f AS (
  SELECT *, string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)) AS lines,
         len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words,
         len(regexp_extract_all(text, '(?m){_sql(C.TOC_LINE)}')) AS toc, len(regexp_extract_all(text, '(?m){_sql(C.INDEX_LINE)}')) AS idx,
         len(list_filter({C.CASE_MARKERS}, lambda m: contains(text, m))) AS marks, len(list_filter({C.STRONG_CASE_MARKERS}, lambda m: contains(text, m))) AS strong,
         len(list_filter({C.CITING_WORDS}, lambda m: contains(text, m))) AS cites,
         list_filter(h, lambda x: regexp_matches(x, '(?m){_sql(C.CHAPTER_HEADING)}')) AS chapters
  FROM d)
SELECT doc_id, CASE
  WHEN coalesce(regexp_replace(text, '\\s', '', 'g'), '') = '' THEN 'empty'
  WHEN len(list_filter(list_append(h, text), lambda x: regexp_matches(x, '(?im){_sql("|".join(f"(?:{p})" for p in C.STRUCTURAL_LINES))}'))) > 0
    OR regexp_matches(text, '(?i){_sql(C.STRUCTURAL_TEXTS[1])}') OR regexp_matches(text, '(?is){_sql(C.STRUCTURAL_TEXTS[0].removeprefix("(?s)"))}')
    OR (len(lines) > 3 AND toc > 0.4 * len(lines)) OR (len(lines) > 5 AND idx > 0.4 * len(lines))
    OR (n_words < 15 AND NOT regexp_matches(substr(text, 1, 100), '\\p{{Ll}}')) THEN 'structural'
  WHEN regexp_matches(coalesce(array_to_string(raw, ' '), ''), '(?im){_sql(C.NOTES_HEADING)}') OR regexp_matches(substr(text, 1, 200), '(?im){_sql(C.NOTES_HEADING)}') THEN 'notes_and_questions'
  WHEN len(list_filter(h, lambda x: regexp_matches(x, '(?i){_sql(C.PROBLEM_HEADING)}'))) > 0 THEN 'problem_hypothetical'
  WHEN len(chapters) > 0 AND ((list_contains(chapters, leaf) AND regexp_matches(leaf, '(?i){_sql(C.INTRODUCTION)}'))
    OR (regexp_extract(leaf, '(?i){_sql(C.DIRECT_INTRODUCTION)}', 1) <> '' AND regexp_extract(leaf, '(?i){_sql(C.DIRECT_INTRODUCTION)}', 1) = regexp_extract(chapters[len(chapters)], '(?i){_sql(C.CHAPTER_NUMBER)}', 1))) THEN 'chapter_introduction'
  WHEN len(list_filter(h, lambda x: regexp_matches(x, '(?im){_sql(C.NOTES_HEADING)}'))) = 0 AND marks >= 2 AND (strong >= 1 OR len(list_filter(h, lambda x: regexp_matches(x, '{_sql(C.CASE_NAME)}'))) > 0) THEN 'case_opinion'
  WHEN (len(lines) > 2 AND len(list_filter(lines, lambda x: length(x) - length(replace(x, '|', '')) >= 2)) > 0.3 * len(lines))
    OR len(list_filter(lines, lambda x: length(x) - length(replace(x, chr(9), '')) >= 2)) >= 3 THEN 'table'
  WHEN len(list_filter(h, lambda x: regexp_full_match(x, '(?i){_sql(C.EXPLANATION_HEADING)}'))) > 0 THEN 'author_narrative'
  WHEN len(list_filter(h, lambda x: regexp_full_match(x, '(?i){_sql(C.RULE_HEADING)}'))) > 0 OR regexp_matches(substr(text, 1, 500), '(?i){_sql(C.STATUTE_OPENING)}') THEN 'statutory_excerpt'
  WHEN regexp_matches(text, '{_sql(C.FOOTNOTE_START)}') AND ((len(regexp_extract_all(text, '(?m){_sql(C.FOOTNOTE_START)}')) >= 2 AND cites >= 3) OR (cites >= 4 AND n_words < 200)) THEN 'footnote'
  ELSE 'author_narrative' END AS content_type FROM f""")
def content_type_classify(spark, sf_dir):
    variants = spark.createDataFrame([(i, lead, raw) for i, (lead, raw, _) in enumerate(VARIANTS)], "k int, lead string, headings array<string>")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(F.broadcast(variants), F.col("doc_id") % len(VARIANTS) == F.col("k"))
    return docs.select("doc_id", F.concat("lead", "text").alias("text"), "headings").select("doc_id", X.content_type(F.col("text"), F.col("headings")).alias("content_type"))


@query("SELECT doc_id, list_has_any(list_transform(['erent', 'LICENSE', 'mentaire'], lambda k: contains(lower(text), lower(k))), [true]) AS hit FROM documents")
def keyword_hits(spark, sf_dir):
    words = F.array(*map(F.lit, ["erent", "LICENSE", "mentaire"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.exists(words, lambda k: F.contains(F.lower("text"), F.lower(k))).alias("hit"))


@query(f"""
WITH t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS token FROM documents)
SELECT doc_id, CAST(CAST('0x' || substr(md5(token), 1, 8) AS UBIGINT) AS BIGINT) AS token_hash, count(*) AS tf FROM t GROUP BY 1, 2""")
def token_hash_vector(spark, sf_dir):
    return retrieval.hashed_terms(table(spark, sf_dir, "documents"))


# --- retrieval

OFFLINE_SQL = f"""
toks AS (SELECT doc_id, list_filter({TOKENS_SQL}, lambda t: t NOT IN ({STOP})) AS tokens FROM documents),
stats AS (SELECT count(*) AS n, coalesce(nullif(avg(len(tokens)), 0), 1.0) AS avgdl FROM toks),
q0 AS (SELECT query_id, list_distinct(list_filter({tokens_sql('query')}, lambda t: t NOT IN ({STOP}))) AS terms FROM (VALUES {ASKED}) AS v(query_id, query)),
q AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM q0),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
sc AS (SELECT query_id, doc_id, n_terms, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 12) AS score, count(*) AS matched
       FROM post JOIN dfs USING (term) JOIN q USING (term), stats GROUP BY 1, 2, 3),
offline AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE matched >= least(2, n_terms) AND score > 0)"""

OKAPI_SQL = f"""
ktoks AS (SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents),
kstats AS (SELECT count(*) AS n, avg(greatest(len(tokens), 1)) AS avgdl, count(*) FILTER (len(tokens) = 0) AS n_empty FROM ktoks),
kvoc AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM ktoks) GROUP BY 1),
kidf0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM kvoc, kstats UNION ALL SELECT NULL, ln(n - n_empty + 0.5) - ln(n_empty + 0.5) FROM kstats WHERE n_empty > 0),
kidf AS (SELECT term, CASE WHEN idf0 < 0 THEN 0.25 * (SELECT avg(idf0) FROM kidf0) ELSE idf0 END AS idf FROM kidf0),
kq AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens_sql('query')}) AS term FROM (VALUES {ASKED}) AS v(query_id, query)) GROUP BY 1, 2),
kpost AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM ktoks) WHERE term IN (SELECT term FROM kq) GROUP BY 1, 2, 3),
ksc AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * times) AS score FROM kpost JOIN kidf USING (term) JOIN kq USING (term), kstats GROUP BY 1, 2),
okapi AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ksc)"""


@query(f"WITH {OFFLINE_SQL} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM offline WHERE rank <= 10")
def bm25_offline_topk(spark, sf_dir):
    return retrieval.bm25_offline(table(spark, sf_dir, "documents"), asked(spark)).withColumn("score", F.round("score", 6))


@query(f"WITH {OKAPI_SQL} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM okapi WHERE rank <= 10")
def bm25_okapi_topk(spark, sf_dir):
    return retrieval.bm25_okapi(table(spark, sf_dir, "documents"), asked(spark)).withColumn("score", F.round("score", 6))


@query(f"""
WITH {OFFLINE_SQL}, {OKAPI_SQL},
lists AS (SELECT query_id, doc_id, 0 AS list, rank, 0.5 AS weight FROM offline WHERE rank <= 40 UNION ALL SELECT query_id, doc_id, 1, rank, 1.0 FROM okapi WHERE rank <= 40),
fused AS (SELECT query_id, doc_id, sum(weight / (10 + rank)) AS score, min(list * 1000 + rank) AS first FROM lists GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS r FROM fused)
SELECT query_id, r AS rank, doc_id, round(score, 9) AS score FROM o WHERE r <= 10""")
def rrf_fusion(spark, sf_dir):
    docs, queries = table(spark, sf_dir, "documents"), asked(spark)
    held = retrieval.postings(docs, [retrieval.query_terms(queries), retrieval.okapi_terms(queries)])
    lists = [(retrieval.bm25_offline(docs, queries, 40, held=held), 0.5), (retrieval.bm25_okapi(docs, queries, 40, held=held), 1.0)]
    return retrieval.rank_fusion(lists).withColumn("score", F.round("score", 9))


@query(f"""
WITH {OFFLINE_SQL}, h AS (SELECT query_id, doc_id, lang FROM offline JOIN documents USING (doc_id) WHERE rank <= 10)
SELECT query_id, count(*) AS hits, count(*) FILTER (lang = 'en') AS compliant, round(count(*) FILTER (lang = 'en') / count(*), 6) AS compliance FROM h GROUP BY query_id""")
def filter_compliance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = retrieval.bm25_offline(docs, asked(spark))
    held = F.broadcast(hits).join(docs.select("doc_id", "lang"), "doc_id").withColumn("ok", F.col("lang").eqNullSafe("en"))
    return held.groupBy("query_id").agg(F.count("*").alias("hits"), F.count(F.when(F.col("ok"), 1)).alias("compliant"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("compliance"))


@query("""
WITH e AS (SELECT label, vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) AS r(i)),
c AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM (SELECT label, i, round(avg(x), 6) AS m FROM e GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT query_id, vec_id, round(list_dot_product(list_transform(embedding::FLOAT[], lambda x: x::DOUBLE), q) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(list_transform(embedding::FLOAT[], lambda x: x::DOUBLE), list_transform(embedding::FLOAT[], lambda x: x::DOUBLE)))), 6) AS score FROM embeddings, c),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 10""")
def vector_topk_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    centres = means.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("q"))
    return retrieval.vector_topk(vectors, centres)


@query("""
WITH q AS (SELECT vec_id AS query_id, list_transform(embedding::FLOAT[], lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id, list_transform(embedding::FLOAT[], lambda x: x::DOUBLE) AS e FROM embeddings WHERE label % 2 = 0),
s AS (SELECT query_id, vec_id, round(list_dot_product(e, q) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(e, e))), 6) AS score FROM v, q)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def vector_topk_filtered(spark, sf_dir):
    """The nearest vectors of even labels to every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.vector_topk(vectors, queries, 5, keep=F.col("label") % 2 == 0)


@query("""
WITH h AS (SELECT l_suppkey AS query_id, l_orderkey AS family_id, l_linenumber > 1 AS is_child, l_linenumber, l_partkey FROM lineitem),
w AS (SELECT *, max(is_child::INT) OVER (PARTITION BY query_id, family_id) AS c FROM h)
SELECT query_id, family_id, l_linenumber, l_partkey FROM w WHERE is_child OR c = 0""")
def family_collapse(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("family_id"), (F.col("l_linenumber") > 1).alias("is_child"), "l_linenumber", "l_partkey")
    return retrieval.collapse_families(hits).drop("is_child")


# --- linkage, windows and context over conversations, events and orders


@query("SELECT conv_id, turn, lag(turn) OVER w AS previous_id, lead(turn) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def adjacency_links(spark, sf_dir):
    return corpus.links(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("turn")).select("conv_id", "turn", "previous_id", "next_id")


@query("""
WITH w AS (SELECT conv_id, turn, lag(turn, 1) OVER w AS p1, lag(turn, 2) OVER w AS p2, lead(turn, 1) OVER w AS n1, lead(turn, 2) OVER w AS n2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT conv_id, turn, 'previous' AS relation, 1 AS distance, p1 AS neighbour FROM w UNION ALL SELECT conv_id, turn, 'previous', 2, p2 FROM w UNION ALL SELECT conv_id, turn, 'next', 1, n1 FROM w UNION ALL SELECT conv_id, turn, 'next', 2, n2 FROM w)
SELECT * FROM u WHERE neighbour IS NOT NULL""")
def neighbor_context_window(spark, sf_dir):
    return corpus.neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT count(DISTINCT conv_id) AS parents, count(*) AS records, count(*) FILTER (p IS NULL AND n IS NULL) AS isolated FROM (SELECT conv_id, lag(turn) OVER w AS p, lead(turn) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))")
def linkage_summary(spark, sf_dir):
    linked = corpus.links(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("turn"))
    return linked.agg(F.countDistinct("conv_id").alias("parents"), F.count("*").alias("records"), F.count(F.when(F.col("previous_id").isNull() & F.col("next_id").isNull(), 1)).alias("isolated"))


@query()
def context_budget(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("cost"))
    return corpus.allocate(items, "conv_id", "turn", "cost", 1500)


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def forward_fill(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("last_purchase"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT o_custkey, o_orderkey, date_diff('day', o_orderdate::DATE, before::DATE) AS days_back FROM o WHERE o_orderdate < before""")
def page_regressions(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.lag("o_orderdate").over(w).alias("before"))
    return orders.where("o_orderdate < before").select("o_custkey", "o_orderkey", F.date_diff("before", "o_orderdate").cast("long").alias("days_back"))


@query("""
WITH s AS (SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS least, round(max(value), 6) AS most, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY 1)
SELECT * FROM s""")
def event_stage_fold(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, epoch_us(min(ts)) // 1000 AS began_ms, epoch_us(max(ts)) // 1000 AS ended_ms FROM s GROUP BY 1, 2""")
def session_windows(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    marked = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("opens", F.when(gap <= 6 * 3600 * 1_000_000, 0).otherwise(1))
    own = marked.withColumn("session", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return own.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.unix_millis(F.min("ts")).alias("began_ms"), F.unix_millis(F.max("ts")).alias("ended_ms"))


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS day_ms, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return own.select(F.unix_millis("w.start").alias("day_ms"), "event_type", "n", "users")


@query("""
WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT before, event_type AS after, count(*) AS n FROM r WHERE before IS NOT NULL GROUP BY 1, 2""")
def status_transitions(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    moved = table(spark, sf_dir, "events").select(F.lag("event_type").over(w).alias("before"), F.col("event_type").alias("after"))
    return moved.where("before is not null").groupBy("before", "after").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(quantile_cont(value, 0.95), 6) AS linear, round(max(value) FILTER (r = (95 * n + 99) // 100), 6) AS nearest_whole,
       round(max(value) FILTER (r = greatest(1, CAST(ceil(0.95 * n) AS BIGINT))), 6) AS nearest_real FROM s GROUP BY 1""")
def percentile_definitions(spark, sf_dir):
    out = corpus.exact_percentiles(table(spark, sf_dir, "events"), "event_type", "value", [0.95])
    return out.select("event_type", F.round("l0", 6).alias("linear"), F.round("w0", 6).alias("nearest_whole"), F.round("r0", 6).alias("nearest_real"))


@query("SELECT event_type, count(*) AS calls, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS most FROM events GROUP BY 1")
def latency_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    means = events.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"))
    places = corpus.exact_percentiles(events, "event_type", "value", [0.5, 0.95]).select("event_type", F.round("l0", 6).alias("p50"), F.round("l1", 6).alias("p95"))
    return means.join(places, "event_type", "left")


# --- evaluation

#: What a labelled document must hold to be judged for a query; the judgments know nothing of the ranking.
JUDGED_BY = "(1, 'thation'), (2, 'erent'), (3, 'ertion'), (4, 'thand'), (5, 'mentaire'), (6, 'schlicheit'), (7, 'heat'), (8, 'ha')"

GRADED_SQL = f"""
WITH {OFFLINE_SQL},
j AS (SELECT query_id, doc_id, (l.quality + 2 * (1 - l.toxic))::DOUBLE AS relevance FROM documents d JOIN labels l USING (doc_id) JOIN (VALUES {JUDGED_BY}) AS v(query_id, word) ON contains(lower(d.text), word)),
pos AS (SELECT * FROM j WHERE relevance > 0),
g AS (SELECT o.query_id, o.rank, o.doc_id, coalesce(p.relevance, 0)::DOUBLE AS relevance FROM offline o LEFT JOIN pos p USING (query_id, doc_id) WHERE o.rank <= 10),
tot AS (SELECT query_id, count(*) AS total FROM pos GROUP BY 1),
ideal AS (SELECT query_id, sum((2 ** relevance - 1) / log2(p + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS p FROM pos) WHERE p <= 10 GROUP BY 1),
seen AS (SELECT *, sum((relevance > 0)::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS s FROM g),
agg AS (SELECT query_id, sum(s / rank) FILTER (relevance > 0) AS ap, min(rank) FILTER (relevance > 0) AS first, count(*) FILTER (relevance > 0) AS hit, sum((2 ** relevance - 1) / log2(rank + 1)) AS dcg FROM seen GROUP BY 1),
m AS (SELECT query_id, coalesce(1 / first, 0) AS mrr, coalesce(ap / total, 0) AS average_precision, coalesce(hit / total, 0) AS recall_at_10, coalesce(dcg / ideal, 0) AS ndcg_at_10, coalesce((first <= 10)::DOUBLE, 0) AS success_at_10
      FROM tot JOIN ideal USING (query_id) LEFT JOIN agg USING (query_id))"""


def judgments(spark, sf_dir):
    """query_id, doc_id and relevance of the labelled documents that hold a query's word."""
    words = values(spark, JUDGED_BY, "query_id, word")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    relevance = (F.col("quality") + 2 * (1 - F.col("toxic"))).cast("double")
    return docs.join(F.broadcast(words), F.contains(F.lower("text"), F.col("word"))).select("query_id", "doc_id", relevance.alias("relevance"))


def _metrics(spark, sf_dir):
    qrels = judgments(spark, sf_dir)
    grades = evaluation.graded(retrieval.bm25_offline(table(spark, sf_dir, "documents"), asked(spark)), qrels)
    return evaluation.query_metrics(grades, qrels, (10,))


@query(GRADED_SQL + " SELECT query_id, round(mrr, 6) AS mrr, round(average_precision, 6) AS average_precision, round(recall_at_10, 6) AS recall_at_10, round(ndcg_at_10, 6) AS ndcg_at_10, round(success_at_10, 6) AS success_at_10 FROM m")
def ndcg_map_mrr(spark, sf_dir):
    out = _metrics(spark, sf_dir)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "query_id"])


@query(GRADED_SQL + """, sl AS (SELECT query_id, unnest(CASE WHEN query_id % 2 = 0 THEN ['tag/even', 'all'] ELSE ['tag/odd', 'all'] END) AS slice FROM m),
lm AS (SELECT query_id, 'mrr' AS metric, mrr AS value FROM m UNION ALL SELECT query_id, 'ndcg_at_10', ndcg_at_10 FROM m UNION ALL SELECT query_id, 'recall_at_10', recall_at_10 FROM m UNION ALL SELECT query_id, 'average_precision', average_precision FROM m UNION ALL SELECT query_id, 'success_at_10', success_at_10 FROM m)
SELECT slice, metric, round(avg(value), 6) AS mean, count(*) AS n_queries FROM lm JOIN sl USING (query_id) GROUP BY 1, 2""")
def slice_metrics(spark, sf_dir):
    slices = asked(spark).select("query_id", F.explode(F.array(F.when(F.col("query_id") % 2 == 0, "tag/even").otherwise("tag/odd"), F.lit("all"))).alias("slice"))
    return evaluation.slice_rollup(_metrics(spark, sf_dir), slices).withColumn("mean", F.round("mean", 6))


@query(GRADED_SQL + """, o AS (SELECT 'mrr' AS metric, avg(mrr) AS observed FROM m UNION ALL SELECT 'ndcg_at_10', avg(ndcg_at_10) FROM m),
lim AS (SELECT * FROM (VALUES ('mrr', 'min', 0.1), ('ndcg_at_10', 'max', 0.05), ('missing', 'min', 0.0)) AS v(metric, kind, bound))
SELECT metric, round(observed, 6) AS observed, kind, CAST(bound AS DOUBLE) AS bound, coalesce(CASE WHEN kind = 'min' THEN observed >= bound ELSE observed <= bound END, false) AS passed FROM lim LEFT JOIN o USING (metric)""")
def metric_gates(spark, sf_dir):
    means = evaluation.long_metrics(_metrics(spark, sf_dir)).groupBy("metric").agg(F.avg("value").alias("value"))
    limits = values(spark, "('mrr', 'min', 0.1D), ('ndcg_at_10', 'max', 0.05D), ('missing', 'min', 0.0D)", "metric, kind, bound")
    return evaluation.gate(means, limits).withColumn("observed", F.round("observed", 6))


@query()
def paired_bootstrap(spark, sf_dir):
    docs, qrels = table(spark, sf_dir, "documents"), judgments(spark, sf_dir)
    measured = lambda hits: evaluation.long_metrics(evaluation.query_metrics(evaluation.graded(hits, qrels), qrels, (10,)))
    one, two = measured(retrieval.bm25_offline(docs, asked(spark))), measured(retrieval.bm25_okapi(docs, asked(spark)))
    pairs = one.withColumnRenamed("value", "baseline").join(two.withColumnRenamed("value", "candidate"), ["query_id", "metric"])
    return evaluation.paired_bootstrap(pairs)


# --- snapshots, identity, plans over sizes and keys


@query("""
WITH o AS (SELECT doc_id AS id, md5(text) AS hash FROM documents WHERE source <> 'src3'), n AS (SELECT doc_id AS id, md5(CASE WHEN lang = 'es' THEN text || '.' ELSE text END) AS hash FROM documents WHERE source <> 'src4')
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.id = n.id""")
def snapshot_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.where("source <> 'src3'").select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"))
    new = docs.where("source <> 'src4'").select(F.col("doc_id").alias("id"), F.md5(F.when(F.col("lang") == "es", F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("hash"))
    return corpus.snapshot_diff(old, new)


@query("""
SELECT 'missing' AS side, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'unexpected', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)""")
def id_parity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda a, b, name: a.join(b, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return count(docs, labels, "missing").unionByName(count(labels, docs, "unexpected"))


@query("""
WITH r AS (SELECT doc_id, source, n_chars % 7 AS chunk_index, text FROM documents),
k1 AS (SELECT source, chunk_index, text, min(doc_id) AS id FROM r GROUP BY 1, 2, 3 HAVING count(DISTINCT doc_id) = 1),
k2 AS (SELECT chunk_index, text, min(doc_id) AS id FROM r GROUP BY 1, 2 HAVING count(DISTINCT doc_id) = 1),
k3 AS (SELECT text, min(doc_id) AS id FROM r GROUP BY 1 HAVING count(DISTINCT doc_id) = 1),
q AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'other' ELSE source END AS source, CASE WHEN lang = 'de' THEN 99 ELSE chunk_index END AS chunk_index, text FROM r JOIN documents USING (doc_id, source, text))
SELECT q.doc_id, coalesce(k1.id, k2.id, k3.id) AS recovered_id FROM q LEFT JOIN k1 ON k1.source = q.source AND k1.chunk_index = q.chunk_index AND k1.text = q.text
LEFT JOIN k2 ON k2.chunk_index = q.chunk_index AND k2.text = q.text LEFT JOIN k3 ON k3.text = q.text""")
def stable_id_recovery(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    index, digest = F.col("n_chars") % 7, F.sha2("text", 256)
    records = docs.select(F.col("doc_id").alias("stable_id"), "source", index.alias("chunk_index"), digest.alias("text"))
    results = docs.select("doc_id", F.when(F.col("lang") == "fr", "other").otherwise(F.col("source")).alias("source"), F.when(F.col("lang") == "de", 99).otherwise(index).alias("chunk_index"), digest.alias("text"))
    return corpus.recover_ids(results, records).select("doc_id", "recovered_id")


@query("SELECT source, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS root, count(*) AS n FROM documents GROUP BY 1")
def digest_roots(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("id"))
    return corpus.ordered_digests(own, "source", ["id"], F.col("id"), "\n")


@query("""
WITH a AS (SELECT doc_id, source, n_chars, doc_id % 1000 AS age FROM documents),
h AS (SELECT *, sum(CASE WHEN age > 800 THEN 0 ELSE n_chars END) OVER (PARTITION BY source ORDER BY age, doc_id ROWS UNBOUNDED PRECEDING) AS held FROM a)
SELECT doc_id, CASE WHEN age > 800 THEN 'age' WHEN held > 50000 THEN 'size' END AS reason FROM h""")
def retention_plan(spark, sf_dir):
    return corpus.retention(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", F.col("doc_id") % 1000, "n_chars", 50000, 800).select("doc_id", "reason")


@query("SELECT o_orderkey, epoch_ms(o_orderdate) AS at_ms, o_totalprice FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-06-01', 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def keyset_page(spark, sf_dir):
    at = F.lit("1996-06-01").cast("timestamp_ntz")
    before = (F.col("o_orderdate") < at) | ((F.col("o_orderdate") == at) & (F.col("o_orderkey") < 5000))
    return table(spark, sf_dir, "orders").where(before).orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(50).select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at_ms"), "o_totalprice")


@query("""
SELECT lang, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, round(sum(ceil(length(text) / 4.0)) * 0.13 / 1e6, 9) AS cost FROM documents GROUP BY lang""")
def cost_projection(spark, sf_dir):
    total = F.sum(X.token_estimate(F.col("text")))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(total.alias("tokens"), F.round(total * 0.13 / 1e6, 9).alias("cost"))


@query("""
WITH d AS (SELECT doc_id, text, n_chars, lang FROM documents)
SELECT 'null_text' AS name, count(*) FILTER (text IS NULL) AS observed, 0 AS required, 'error' AS level FROM d
UNION ALL SELECT 'length_mismatch', count(*) FILTER (n_chars <> length(text)), 0, 'error' FROM d
UNION ALL SELECT 'duplicate_ids', count(*) - count(DISTINCT doc_id), 0, 'error' FROM d
UNION ALL SELECT 'ids_contiguous', max(doc_id) - min(doc_id) + 1 - count(DISTINCT doc_id), 0, 'error' FROM d
UNION ALL SELECT 'canonical_text_duplicates', count(*) - count(DISTINCT md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))), 0, 'warning' FROM d
UNION ALL SELECT 'unknown_lang', count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es') OR lang IS NULL), 0, 'error' FROM d""")
def quality_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    bad = {
        "null_text": F.count(F.when(F.col("text").isNull(), 1)),
        "length_mismatch": F.count(F.when(F.col("n_chars") != F.length("text"), 1)),
        "duplicate_ids": F.count("*") - F.countDistinct("doc_id"),
        "ids_contiguous": F.max("doc_id") - F.min("doc_id") + 1 - F.countDistinct("doc_id"),
        "canonical_text_duplicates": F.count("*") - F.countDistinct(F.md5(X.canonical(F.col("text")))),
        "unknown_lang": F.count(F.when(~F.coalesce(F.col("lang").isin("en", "de", "fr", "es"), F.lit(False)), 1)),
    }
    one = d.agg(*[c.cast("long").alias(n) for n, c in bad.items()])
    rows = one.unpivot([], list(bad), "name", "observed")
    return rows.select("name", "observed", F.lit(0).alias("required"), F.when(F.col("name") == "canonical_text_duplicates", "warning").otherwise("error").alias("level"))


# --- benchmark overlap and transcription rates


@query("""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 3))) AS i FROM w)),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3))) AS i FROM dw))
SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (s) GROUP BY 1, 2""")
def contamination_join(spark, sf_dir):
    def shingles(df, key):
        words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
        own = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.concat_ws(" ", F.slice("w", i, F.lit(5))))
        return df.select(key, words.alias("w")).where(F.size("w") >= 5).select(key, F.explode(F.array_distinct(own)).alias("s"))

    items = shingles(table(spark, sf_dir, "benchmark"), "item_id")
    docs = shingles(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id")
    return docs.join(items, "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query()
def edit_distance_rates(spark, sf_dir):
    """Distances count code points of the whole texts; DuckDB's count bytes, so the test holds them against brute force."""
    b = table(spark, sf_dir, "benchmark")
    pairs = b.select("item_id", F.col("text").alias("reference")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("prediction")), "item_id")
    d = F.levenshtein("reference", "prediction")
    return pairs.select("item_id", d.cast("long").alias("distance"), F.length("reference").cast("long").alias("units"), F.round(d / F.length("reference"), 6).alias("rate"))


@query()
def word_edit_counts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    pairs = b.select("item_id", F.col("text").alias("reference")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("prediction")), "item_id")
    return pairs.select("item_id", udfs.word_edits("reference", "prediction").alias("x")).select("item_id", "x.*")


@query("""
WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), k AS (SELECT unnest(['the', 'and', 'der', 'les']) AS token),
c AS (SELECT doc_id, token, len(list_filter(w, lambda x: x = token)) AS prediction, len(list_filter(w, lambda x: x = token)) + (doc_id % 3) - 1 AS reference FROM t, k)
SELECT token, sum(greatest(reference, 0))::BIGINT AS reference, sum(least(greatest(reference, 0), prediction))::BIGINT AS matched FROM c GROUP BY token""")
def critical_token_counts(spark, sf_dir):
    words = F.split("text", " ")

    def same(t):
        return lambda x: x == t

    own = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.size(F.filter(words, same(t))).alias("prediction")) for t in ("the", "and", "der", "les")])).alias("x"))
    reference = F.greatest(F.col("x.prediction") + F.col("doc_id") % 3 - 1, F.lit(0))
    return own.groupBy("x.token").agg(F.sum(reference).alias("reference"), F.sum(F.least(reference, F.col("x.prediction"))).alias("matched"))


@query("""
WITH r AS (SELECT user_id, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS a1, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS a2, max(CASE WHEN event_id % 2 = 0 THEN value END) AS b1, max(CASE WHEN event_id % 2 = 1 THEN value END) AS b2 FROM events GROUP BY 1),
d AS (SELECT user_id, sign(round(a2 - a1, 9)) AS x, sign(round(b2 - b1, 9)) AS y FROM r WHERE a1 IS NOT NULL AND a2 IS NOT NULL)
SELECT CASE WHEN x = 0 AND y = 0 THEN 'unchanged' WHEN x <= 0 AND y <= 0 THEN 'improved' WHEN x >= 0 AND y >= 0 THEN 'regressed' ELSE 'mixed' END AS outcome, count(*) AS n FROM d GROUP BY 1""")
def outcome_lattice(spark, sf_dir):
    even, odd = F.when(F.col("event_id") % 2 == 0, F.col("value")), F.when(F.col("event_id") % 2 == 1, F.col("value"))
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(even).alias("a1"), F.avg(odd).alias("a2"), F.max(even).alias("b1"), F.max(odd).alias("b2")).where("a1 is not null and a2 is not null")
    d = r.select(F.signum(F.round(F.col("a2") - F.col("a1"), 9)).alias("x"), F.signum(F.round(F.col("b2") - F.col("b1"), 9)).alias("y"))
    kind = F.when((F.col("x") == 0) & (F.col("y") == 0), "unchanged").when((F.col("x") <= 0) & (F.col("y") <= 0), "improved").when((F.col("x") >= 0) & (F.col("y") >= 0), "regressed").otherwise("mixed")
    return d.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


@query("""
SELECT page_id, url IS NOT NULL AND regexp_matches(url, '^https?://[a-z0-9.-]+(/|$)') AS well_formed, regexp_matches(url, '\\s') AS spaced,
       regexp_extract(url, '^(https?)://', 1) AS scheme, length(html) AS n_html FROM pages""")
def url_shape_checks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", (F.col("url").isNotNull() & F.col("url").rlike("^https?://[a-z0-9.-]+(/|$)")).alias("well_formed"), F.col("url").rlike(r"\s").alias("spaced"), F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), F.length("html").cast("long").alias("n_html"))
