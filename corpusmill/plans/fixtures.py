"""Queries whose rows are built from the corpus tables: citations, tables, grounding, trees, page geometry, record checks and samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import constants as C
from corpusmill.functions import udfs
from corpusmill.operators import corpus, ocr, quality, records
from corpusmill.plans.catalog import query
from corpusmill.sources.tables import spread, table, values


def text_of(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def opinions(spark, sf_dir):
    """One sentence on two nations for each order: stable_id and text."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.initcap("n_name").alias("n"))
    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", ((F.col("c_nationkey") + F.col("o_orderkey")) % 25).alias("other"))
    a, b = (nation.select(F.col("n_nationkey").alias(f"k{s}"), F.col("n").alias(f"n{s}")) for s in "ab")
    both = own.join(F.broadcast(a), F.col("c_nationkey") == F.col("ka")).join(F.broadcast(b), F.col("other") == F.col("kb"))
    chapter = F.col("o_orderkey") % 20
    return both.select(F.col("o_orderkey").alias("stable_id"), text_of("See ", F.col("na"), " v. ", F.col("nb"), "; Ch.", chapter, ".A.", F.col("o_orderkey") % 3, ", then Ch.", chapter, ". In re ", F.col("na"), " followed ", F.col("na"), " v. ", F.col("nb"), ".").alias("text"))


OPINIONS_SQL = """
n AS (SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS n FROM nation),
r AS (SELECT o_orderkey AS stable_id, 'See ' || a.n || ' v. ' || b.n || '; Ch.' || (o_orderkey % 20) || '.A.' || (o_orderkey % 3) || ', then Ch.' || (o_orderkey % 20) || '. In re ' || a.n || ' followed ' || a.n || ' v. ' || b.n || '.' AS text
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN n a ON a.n_nationkey = c_nationkey JOIN n b ON b.n_nationkey = (c_nationkey + o_orderkey) % 25),
f AS (SELECT stable_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{case}', 1), lambda x: regexp_replace(regexp_replace(x, '[.,;]+$', ''), '^See ', '')))) AS name FROM r)""".replace("{case}", C.CASE_NAME.replace("'", "''"))


@query(f"""
WITH {OPINIONS_SQL},
g AS (SELECT DISTINCT stable_id, unnest(regexp_extract_all(text, '(Ch\\.\\d+(?:\\.[A-Z0-9]+)*)', 1)) AS ref FROM r)
SELECT stable_id AS source, 'case:' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS target, 1 AS mentions FROM f UNION ALL SELECT stable_id, 'ref:' || lower(ref), 1 FROM g""")
def citation_edges(spark, sf_dir):
    return records.citation_edges(opinions(spark, sf_dir))


@query(f"WITH {OPINIONS_SQL} SELECT name, count(*) AS n_records, min(stable_id) AS first_id, list_slice(list(stable_id ORDER BY stable_id), 1, 8)::BIGINT[] AS locations FROM f GROUP BY name")
def case_index(spark, sf_dir):
    return records.case_index(opinions(spark, sf_dir))


@query(f"""
WITH {OPINIONS_SQL}, e AS (SELECT DISTINCT stable_id, name FROM f)
SELECT 'case' AS kind, name AS node, count(*) AS degree FROM e GROUP BY name
UNION ALL SELECT 'record', stable_id::VARCHAR, count(*) FROM e GROUP BY stable_id""")
def citation_nodes(spark, sf_dir):
    return records.citation_nodes(opinions(spark, sf_dir))


def supplier_tables(spark, sf_dir):
    """Markdown tables of the suppliers of each nation, in up to three fragments: source_key, stable_id, text, is_child."""
    own = table(spark, sf_dir, "supplier").withColumn("fragment", F.col("s_suppkey") % 3)
    row = text_of("| ", F.col("s_suppkey"), " | ", F.col("s_name"), "\\|", F.col("s_nationkey"), " |")
    parts = own.groupBy("s_nationkey", "fragment").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))).alias("rows"))
    body = F.concat(F.array(F.lit("Suppliers"), F.lit("| key | name |"), F.lit("|---|:---|")), F.transform("rows", lambda r: r["row"]))
    return parts.select(F.col("s_nationkey").alias("source_key"), text_of(F.col("s_nationkey"), "-", F.col("fragment")).alias("stable_id"), F.array_join(body, "\n").alias("text"), F.lit(False).alias("is_child"))


CHILDREN_SQL = """
s AS (SELECT s_nationkey AS source_key, s_nationkey || '-' || (s_suppkey % 3) AS stable_id, s_suppkey, '| ' || s_suppkey || ' | ' || s_name || '\\|' || s_nationkey || ' |' AS line FROM supplier),
c AS (SELECT source_key, stable_id, CAST(row_number() OVER (PARTITION BY stable_id ORDER BY s_suppkey) - 1 AS INTEGER) AS child_index, CAST(count(*) OVER (PARTITION BY stable_id) AS INTEGER) AS child_count, line, count(*) OVER (PARTITION BY source_key) AS total FROM s)"""


@query(f"WITH {CHILDREN_SQL} SELECT stable_id, child_index, child_count, 'Suppliers' || chr(10) || '| key | name |' || chr(10) || '|---|:---|' || chr(10) || line AS child_text FROM c WHERE total >= 4")
def table_children(spark, sf_dir):
    return records.table_children(supplier_tables(spark, sf_dir), of_parent=None, of_all=None)


@query(f"""
WITH {CHILDREN_SQL}, p AS (SELECT stable_id, any_value(source_key) AS source_key, count(*) AS n, any_value(total) AS total FROM c GROUP BY 1)
SELECT stable_id, CASE WHEN total >= 4 THEN 'table_parent' END AS retrieval_role, 0 AS child, CASE WHEN total >= 4 THEN n END AS child_count, CASE WHEN total >= 4 THEN total END AS source_rows, CASE WHEN total >= 4 THEN count(*) OVER (PARTITION BY source_key) END AS source_fragments FROM p
UNION ALL SELECT stable_id, 'table_child', 1, child_count, NULL, NULL FROM c WHERE total >= 4""")
def table_family_union(spark, sf_dir):
    out = records.with_table_children(supplier_tables(spark, sf_dir), of_parent=None, of_all=None)
    return out.select(F.coalesce("table_parent_stable_id", "stable_id").alias("stable_id"), "retrieval_role", F.when(F.col("retrieval_role") == "table_child", 1).otherwise(0).alias("child"), F.col("child_count").cast("long").alias("child_count"), F.col("source_rows").cast("long").alias("source_rows"), F.col("source_fragments").cast("long").alias("source_fragments"))


@query("""
WITH d AS (SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS id FROM documents)
SELECT doc_id, CASE WHEN count(*) OVER w > 1 THEN row_number() OVER (PARTITION BY id ORDER BY doc_id) - 1 END AS occurrence FROM d WINDOW w AS (PARTITION BY id)""")
def fragment_occurrences(spark, sf_dir):
    from corpusmill.functions import text as X

    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(X.canonical(F.col("text"))).alias("stable_id"))
    return records.occurrences(rows, "stable_id", "doc_id").select("doc_id", "occurrence")


SOURCES = "('S1', 's-1', 'the court held'), ('S2', 's-2', 'and so on'), ('S3', 's-3', 'x')"
#: Answers by order number: unit, whether the answer abstained, the id that entails it and its anchor.
CLAIMS = "(0, 'Held so [S1].', false, 's-1', 'held'), (1, 'And so [S2, S1].', false, 's-2', 'so'), (2, 'Not at all [S3].', false, 's-9', 'x'), (3, 'No source.', false, 's-1', 'held'), (4, 'Unfounded [S1].', false, NULL, NULL), (5, 'Silent.', true, NULL, NULL), (6, 'Held, on the whole [S1; S1].', false, 's-1', 'court')"

CLAIMS_SQL = f"""
t AS (SELECT * FROM (VALUES {CLAIMS}) AS v(k, unit, abstained, sid, anchor)), s AS (SELECT * FROM (VALUES {SOURCES}) AS v(citation_id, source_id, excerpt)),
c AS (SELECT o_orderkey AS claim_id, t.* FROM orders JOIN t ON k = o_orderkey % 7),
e AS (SELECT claim_id, unnest(list_distinct(list_transform(regexp_extract_all(g, '(?i)S\\d+'), lambda x: upper(x)))) AS citation_id FROM (SELECT claim_id, unnest(regexp_extract_all(unit, '\\[([^\\[\\]]+)\\]', 1)) AS g FROM c) WHERE regexp_full_match(regexp_replace(g, '(?i)S\\d+', '', 'g'), '[ \\t,;:&/-]*')),
j AS (SELECT c.claim_id, c.sid, c.abstained, e.citation_id, coalesce(s.source_id = c.sid AND contains(s.excerpt, c.anchor), false) AS good FROM c LEFT JOIN e USING (claim_id) LEFT JOIN s USING (citation_id)),
r AS (SELECT claim_id, max(sid) IS NOT NULL AS supported, CASE WHEN max(sid) IS NOT NULL THEN NOT bool_or(abstained) AND count(citation_id) > 0 AND bool_and(good) ELSE bool_and(abstained) END AS passed FROM j GROUP BY 1)"""


def _claims(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"))
    rows = own.join(F.broadcast(values(spark, CLAIMS, "k, answer_unit, abstained, sid, anchor")), F.col("claim_id") % 7 == F.col("k"))
    entailed = F.when(F.col("sid").isNull(), F.array().cast("array<struct<source_id:string,anchor:string>>")).otherwise(F.array(F.struct(F.col("sid").cast("string").alias("source_id"), F.col("anchor").cast("string").alias("anchor"))))
    return records.claim_scores(rows.select("claim_id", "answer_unit", "abstained", entailed.alias("entailed_by")), values(spark, SOURCES, "citation_id, source_id, excerpt"))


@query(f"WITH {CLAIMS_SQL} SELECT * FROM r")
def claim_scores(spark, sf_dir):
    return _claims(spark, sf_dir)


@query(f"""
WITH {CLAIMS_SQL} SELECT 'claim_citation_entailment_accuracy' AS metric, count(*) FILTER (passed) / count(*) AS value FROM r WHERE supported
UNION ALL SELECT 'unsupported_claim_rate', count(*) FILTER (NOT passed) / count(*) FROM r WHERE NOT supported""")
def grounding_ratios(spark, sf_dir):
    scored = _claims(spark, sf_dir)
    n = lambda c: F.count(F.when(c, 1))
    counts = scored.agg(n(F.col("supported") & F.col("passed")).alias("supported_claims_correct"), n(F.col("supported")).alias("supported_claims_total"), n(~F.col("supported") & ~F.col("passed")).alias("unsupported_claims_exposed"), n(~F.col("supported")).alias("unsupported_claims_total"))
    return records.grounding_ratios(counts)


#: Endings of answers that begin with the first words of a document.
ENDINGS = [" so [S1].", " so [S9].", " so.", " so [s2; S1].<think>[S8]</think>", " so [S1].\n\nAnd more", "INSUFFICIENT_EVIDENCE.", " [see S1 here].", " so [S1].\n12\nand [S2]."]
ENDINGS_SQL = ", ".join("'" + e.replace("\n", "' || chr(10) || '") + "'" for e in ENDINGS)


@query(f"""
WITH a AS (SELECT doc_id AS answer_id, regexp_replace(CASE WHEN doc_id % 8 = 5 THEN '' ELSE regexp_replace(text, '[\\[\\]\\n<>.]', ' ', 'g') END || [{ENDINGS_SQL}][doc_id % 8 + 1], '(?s)<think>.*?</think>', '', 'g') AS t FROM documents),
g AS (SELECT answer_id, unnest(regexp_extract_all(t, '\\[([^\\[\\]]+)\\]', 1)) AS g FROM a),
c AS (SELECT answer_id, list_distinct(flatten(list(list_transform(regexp_extract_all(g, '(?i)S\\d+'), lambda x: upper(x))))) AS ids FROM g WHERE regexp_matches(g, '(?i)S\\d') AND regexp_full_match(regexp_replace(g, '(?i)S\\d+', '', 'g'), '[ \\t,;:&/-]*') GROUP BY 1)
SELECT answer_id, CASE WHEN upper(regexp_replace(trim(t), '[. ]+$', '')) = 'INSUFFICIENT_EVIDENCE' THEN 'insufficient' WHEN len(list_filter(ids, lambda x: x NOT IN ('S1', 'S2'))) > 0 THEN 'unknown_source' WHEN ids IS NULL THEN 'no_citation'
  WHEN len(list_filter(regexp_split_to_array(trim(t), '\\n+'), lambda p: regexp_matches(p, '[A-Za-z]') AND NOT regexp_matches(p, '(?i)\\[[^\\[\\]]*S\\d+[^\\[\\]]*\\]'))) > 0 THEN 'uncited_paragraph' ELSE 'ok' END AS verdict
FROM a LEFT JOIN c USING (answer_id)""")
def answer_verdicts(spark, sf_dir):
    head = F.regexp_replace("text", r"[\[\]\n<>.]", " ")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 8 + 1).cast("int"))
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), F.concat(F.when(F.col("doc_id") % 8 == 5, "").otherwise(head), ending).alias("answer"))
    return records.answer_verdict(answers.withColumn("known_ids", F.array(F.lit("S1"), F.lit("S2"))))


@query("""
WITH d AS (SELECT doc_id, regexp_replace(text, '["“”\\[\\]]', ' ', 'g') AS t FROM documents),
a AS (SELECT doc_id AS answer_id, CASE WHEN doc_id % 3 = 0 THEN lower(regexp_replace(substr(t, 11, 20), '\\s', '  ', 'g')) WHEN doc_id % 3 = 1 THEN reverse(regexp_replace(substr(t, 11, 20), '\\s', ' ', 'g')) ELSE regexp_replace(substr(t, 2, 5), '\\s', ' ', 'g') END AS quote, regexp_replace(lower(t), '\\s+', ' ', 'g') AS evidence FROM d)
SELECT answer_id, quote FROM a WHERE length(quote) >= 8 AND trim(regexp_replace(lower(quote), '\\s+', ' ', 'g')) <> '' AND NOT contains(evidence, trim(regexp_replace(lower(quote), '\\s+', ' ', 'g')))""")
def unsupported_quotes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r'["“”\[\]]', " ").alias("t"))
    part = F.substring("t", 11, 20)
    quote = F.when(F.col("doc_id") % 3 == 0, F.lower(F.regexp_replace(part, r"\s", "  "))).when(F.col("doc_id") % 3 == 1, F.reverse(F.regexp_replace(part, r"\s", " "))).otherwise(F.regexp_replace(F.substring("t", 2, 5), r"\s", " "))
    answers = docs.select(F.col("doc_id").alias("answer_id"), text_of('He said "', quote, '" [S', F.col("doc_id"), "].").alias("answer"))
    return records.unsupported_quotes(answers, docs.select(text_of("S", F.col("doc_id")).alias("citation_id"), F.col("t").alias("excerpt")))


TREE_SQL = """
e AS (SELECT r_regionkey * 1000000 AS node, NULL::BIGINT AS parent, r_name AS title FROM region
  UNION ALL SELECT r_regionkey * 1000000 + 1000 + n_nationkey, r_regionkey * 1000000, n_name FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 100000000 + s_suppkey, n_regionkey * 1000000 + 1000 + n_nationkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


@query(f"""
WITH RECURSIVE {TREE_SQL}, t AS (SELECT node, 0 AS level, title AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.node, t.level + 1, t.path || ' > ' || e.title FROM e JOIN t ON e.parent = t.node) SELECT * FROM t""")
def toc_paths(spark, sf_dir):
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    top = region.select((F.col("r_regionkey").cast("long") * 1000000).alias("node"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("title"))
    own = F.col("n_regionkey").cast("long") * 1000000
    middle = nation.select((own + 1000 + F.col("n_nationkey")).alias("node"), own.alias("parent"), F.col("n_name").alias("title"))
    leaves = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select((F.lit(100000000) + F.col("s_suppkey")).cast("long").alias("node"), (own + 1000 + F.col("n_nationkey")).alias("parent"), F.col("s_name").alias("title"))
    return records.tree_paths(top.unionByName(middle).unionByName(leaves))


#: Order lines numbered afresh: their own numbers repeat.
ITEMS_SQL = "items AS (SELECT * EXCLUDE l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS l_linenumber FROM lineitem)"
PAGES_SQL = f"{ITEMS_SQL}, p AS (SELECT l_orderkey AS book, l_linenumber AS ord, CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_partkey % 40 + 1 AS BIGINT) END AS page FROM items)"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))


def _toc_pages(spark, sf_dir):
    return _items(spark, sf_dir).select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_partkey") % 5 != 0, (F.col("l_partkey") % 40 + 1).cast("long")).alias("page"))


@query(f"""
WITH {PAGES_SQL}, e AS (SELECT book, ord, last_value(page IGNORE NULLS) OVER (PARTITION BY book ORDER BY ord ROWS UNBOUNDED PRECEDING) AS start_page FROM p),
n AS (SELECT e.book, e.ord, arg_min(l.start_page, l.ord) AS next_page FROM e JOIN e l ON l.book = e.book AND l.ord > e.ord AND l.start_page > e.start_page GROUP BY 1, 2)
SELECT e.book, e.ord, start_page, CASE WHEN start_page IS NOT NULL THEN coalesce(next_page - 1, 50) END AS end_page FROM e LEFT JOIN n USING (book, ord)""")
def toc_page_ranges(spark, sf_dir):
    return corpus.page_ranges(_toc_pages(spark, sf_dir), 50).drop("granted")


@query(f"""
WITH {PAGES_SQL}, e AS (SELECT book, ord, last_value(page IGNORE NULLS) OVER (PARTITION BY book ORDER BY ord ROWS UNBOUNDED PRECEDING) AS start_page FROM p),
n AS (SELECT e.book, e.ord, arg_min(l.start_page, l.ord) AS next_page FROM e JOIN e l ON l.book = e.book AND l.ord > e.ord AND l.start_page > e.start_page GROUP BY 1, 2),
r AS (SELECT e.book, e.ord, start_page, coalesce(next_page - 1, 50) AS end_page FROM e LEFT JOIN n USING (book, ord) WHERE start_page IS NOT NULL)
SELECT book, CAST(x.page AS BIGINT) AS page, min(ord) AS owner FROM r, range(1, 51) AS x(page) WHERE x.page BETWEEN start_page AND end_page AND book % 10 = 1 GROUP BY 1, 2""")
def page_owners(spark, sf_dir):
    """Which contents row holds each page of every tenth book: the first whose range has it."""
    ranges = corpus.page_ranges(_toc_pages(spark, sf_dir).where("book % 10 = 1"), 50)
    pages = ranges.select("book").distinct().select("book", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(50).cast("long"))).alias("page"))
    return corpus.in_ranges(pages, ranges.select("book", "start_page", "end_page", "ord"), "book").groupBy("book", "page").agg(F.min("ord").alias("owner"))


BOXES_SQL = ITEMS_SQL + """,
r AS (SELECT l_orderkey AS page, l_linenumber AS region_id, (l_partkey % 50)::DOUBLE AS l, (l_suppkey % 40)::DOUBLE AS t, (l_partkey % 50 + 5 + l_quantity)::DOUBLE AS rr, (l_suppkey % 40 + 10)::DOUBLE AS b FROM items WHERE l_linenumber % 2 = 0),
n AS (SELECT l_orderkey AS page, l_linenumber AS line_id, (l_partkey % 60)::DOUBLE AS l, (l_suppkey % 60)::DOUBLE AS t, (l_partkey % 60 + 1 + l_quantity)::DOUBLE AS rr, (l_suppkey % 60 + 2)::DOUBLE AS b FROM items WHERE l_linenumber % 2 = 1)"""


def _boxes(spark, sf_dir):
    items, box = _items(spark, sf_dir), lambda at, wide, tall, most: [(F.col("l_partkey") % at).cast("double").alias("left"), (F.col("l_suppkey") % most).cast("double").alias("top"), (F.col("l_partkey") % at + wide + F.col("l_quantity")).cast("double").alias("right"), (F.col("l_suppkey") % most + tall).cast("double").alias("bottom")]
    regions = items.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("region_id"), *box(50, 5, 10, 40))
    return regions, items.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line_id"), *box(60, 1, 2, 60))


@query(f"""
WITH {BOXES_SQL}
SELECT r.page, region_id, line_id, round((least(n.rr, r.rr) - greatest(n.l, r.l)) * (least(n.b, r.b) - greatest(n.t, r.t)) / ((n.rr - n.l) * (n.b - n.t)), 6) AS share
FROM r JOIN n ON r.page = n.page AND least(n.rr, r.rr) >= greatest(n.l, r.l) AND least(n.b, r.b) >= greatest(n.t, r.t)""")
def region_lines(spark, sf_dir):
    return records.boxes_overlap(*_boxes(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(f"""
WITH {BOXES_SQL}, o AS (SELECT n.page, line_id, region_id FROM n JOIN r ON r.page = n.page AND n.l >= r.l AND n.rr <= r.rr AND n.t >= r.t AND n.b <= r.b)
SELECT n.page, n.line_id, count(region_id) AS candidates, CASE WHEN count(region_id) = 1 THEN min(region_id) END AS region_id FROM n LEFT JOIN o USING (page, line_id) GROUP BY 1, 2""")
def line_assignment(spark, sf_dir):
    return ocr.assign_lines(*_boxes(spark, sf_dir))


@query(f"""
WITH {BOXES_SQL}, o AS (SELECT r.page, region_id, line_id FROM r JOIN n ON r.page = n.page AND least(n.rr, r.rr) >= greatest(n.l, r.l) AND least(n.b, r.b) >= greatest(n.t, r.t)),
k AS (SELECT r.page, r.region_id, count(o.line_id) AS n FROM r LEFT JOIN o USING (page, region_id) GROUP BY 1, 2)
SELECT CASE WHEN n = 0 THEN 'no_recovered_line' WHEN n = 1 THEN 'one_line' ELSE 'several_lines' END AS status, count(*) AS regions, count(DISTINCT page) AS pages FROM k GROUP BY 1""")
def omission_status(spark, sf_dir):
    return ocr.omission_status(*_boxes(spark, sf_dir))


@query(f"""
WITH {BOXES_SQL}, i AS (SELECT r.page, region_id, line_id, (least(n.rr, r.rr) - greatest(n.l, r.l)) * (least(n.b, r.b) - greatest(n.t, r.t)) AS a, (n.rr - n.l) * (n.b - n.t) AS an, (r.rr - r.l) * (r.b - r.t) AS ar
  FROM r JOIN n ON r.page = n.page AND least(n.rr, r.rr) > greatest(n.l, r.l) AND least(n.b, r.b) > greatest(n.t, r.t)),
g AS (SELECT page, region_id, line_id, round(a / (an + ar - a), 6) AS iou, count(*) OVER (PARTITION BY page, region_id) AS x, count(*) OVER (PARTITION BY page, line_id) AS y FROM i WHERE a >= 0.5 * least(an, ar))
SELECT page, region_id, line_id, iou, CASE WHEN x = 1 AND y = 1 THEN 'one_to_one' WHEN x > 1 AND y = 1 THEN 'split' WHEN x = 1 THEN 'merge' ELSE 'tangled' END AS kind FROM g""")
def box_graph(spark, sf_dir):
    return ocr.overlap_graph(*_boxes(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


@query(f"""
WITH {BOXES_SQL}, h AS (SELECT page, line_id, t, b, median(b - t) OVER (PARTITION BY page) AS h, max(b) OVER (PARTITION BY page ORDER BY t, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM n)
SELECT page, line_id, sum(CASE WHEN t - above > 2.5 * h THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY t, line_id ROWS UNBOUNDED PRECEDING)::BIGINT AS band FROM h""")
def vertical_bands(spark, sf_dir):
    return records.vertical_bands(_boxes(spark, sf_dir)[1])


ORDERS_SQL = ITEMS_SQL + """,
l AS (SELECT DISTINCT ON (l_orderkey, l_partkey) l_orderkey, l_partkey, l_linenumber, l_shipdate, l_quantity FROM items ORDER BY l_orderkey, l_partkey, l_linenumber),
ref AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM l WHERE l_linenumber <> 2),
pre AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey) AS j FROM l WHERE l_quantity > 10),
both_ AS (SELECT l_orderkey, i, j FROM ref JOIN pre USING (l_orderkey, l_partkey))"""


def _orders(spark, sf_dir):
    """Reading orders: parts by line number (without the second line) and, of those in quantity, by ship date."""
    items = _items(spark, sf_dir)
    first = items.groupBy("l_orderkey", "l_partkey").agg(F.min(F.struct("l_linenumber", "l_shipdate", "l_quantity")).alias("x")).select("l_orderkey", "l_partkey", "x.*")
    listed = lambda keep, key: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(key.alias("k"), F.col("l_partkey").alias("p"))))), lambda s: s["p"])
    return first.groupBy(F.col("l_orderkey").alias("id")).agg(listed(F.col("l_linenumber") != 2, F.col("l_linenumber")).alias("reference"), listed(F.col("l_quantity") > 10, F.col("l_shipdate")).alias("prediction")).withColumn("split", F.when(F.col("id") % 2 == 0, "calibration").otherwise("held_out"))


@query(f"""
WITH {ORDERS_SQL},
inv AS (SELECT a.l_orderkey, count(*) AS n FROM both_ a JOIN both_ b ON a.l_orderkey = b.l_orderkey AND a.j < b.j AND a.i > b.i GROUP BY 1),
o AS (SELECT DISTINCT l_orderkey FROM l), x AS (SELECT o.l_orderkey, (SELECT count(*) FROM ref WHERE ref.l_orderkey = o.l_orderkey) AS regions, (SELECT count(*) FROM both_ WHERE both_.l_orderkey = o.l_orderkey) AS found, coalesce(n, 0) AS inverted FROM o LEFT JOIN inv USING (l_orderkey))
SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'calibration' ELSE 'held_out' END AS split, round(sum(found) / sum(regions), 9) AS region_recall, round(sum(inverted) / sum(found * (found - 1) / 2), 6) AS inversion_rate FROM x GROUP BY 1""")
def structure_scores(spark, sf_dir):
    return records.structure_scores(_orders(spark, sf_dir)).withColumn("inversion_rate", F.round("inversion_rate", 6)).withColumn("region_recall", F.round("region_recall", 9))


@query(f"""
WITH {ORDERS_SQL}, x AS (SELECT l_orderkey FROM l GROUP BY 1)
SELECT l_orderkey AS id, (SELECT count(*) FROM pre p WHERE p.l_orderkey = x.l_orderkey AND NOT EXISTS (SELECT 1 FROM ref r WHERE r.l_orderkey = p.l_orderkey AND r.l_partkey = p.l_partkey)) AS extra,
  (SELECT count(*) FROM ref p WHERE p.l_orderkey = x.l_orderkey AND NOT EXISTS (SELECT 1 FROM pre r WHERE r.l_orderkey = p.l_orderkey AND r.l_partkey = p.l_partkey)) AS missing FROM x""")
def region_sets(spark, sf_dir):
    return _orders(spark, sf_dir).select("id", F.size(F.array_except("prediction", "reference")).cast("long").alias("extra"), F.size(F.array_except("reference", "prediction")).cast("long").alias("missing"))


@query("SELECT doc_id AS id, CASE WHEN source IS DISTINCT FROM 'src1' THEN 'backend' WHEN lang IS DISTINCT FROM 'en' THEN 'embedding_model' WHEN n_chars % 3 IS DISTINCT FROM 1 THEN 'embedding_dimension' END AS mismatch FROM documents")
def manifest_mismatch(spark, sf_dir):
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("backend"), F.col("lang").alias("embedding_model"), (F.col("n_chars") % 3).alias("embedding_dimension"))
    return records.manifest_mismatch(held, {"backend": "src1", "embedding_model": "en", "embedding_dimension": 1}).select("id", "mismatch")


@query("""
WITH c AS (SELECT doc_id AS check_id, CASE doc_id % 9 WHEN 7 THEN NULL WHEN 8 THEN '  ' ELSE text END AS text,
  CASE doc_id % 9 WHEN 1 THEN '' WHEN 2 THEN substr(text, 1, 1) WHEN 3 THEN '#none#' WHEN 4 THEN substr(text, 40, 10) ELSE substr(text, 5, 12) END AS a,
  CASE doc_id % 9 WHEN 0 THEN '' WHEN 4 THEN substr(text, 5, 12) ELSE substr(text, 40, 10) END AS b,
  CASE WHEN doc_id % 9 = 5 THEN 'other' WHEN doc_id % 9 = 1 THEN substr(text, 1, 39) WHEN doc_id % 9 = 0 THEN substr(text, 17) ELSE substr(text, 17, 23) END AS want FROM documents),
p AS (SELECT *, CASE WHEN a = '' THEN 1 ELSE strpos(text, a) + length(a) END AS s, CASE WHEN b = '' THEN length(text) + 1 ELSE strpos(text, b) END AS e,
  a <> '' AND strpos(text, a) = 0 OR b <> '' AND strpos(text, b) = 0 AS missing, a <> '' AND strpos(substr(text, strpos(text, a) + 1), a) > 0 OR b <> '' AND strpos(substr(text, strpos(text, b) + 1), b) > 0 AS twice FROM c),
r AS (SELECT check_id, CASE WHEN text IS NULL THEN 'not_available' WHEN trim(text) = '' THEN 'empty_candidate_context' WHEN missing THEN 'anchor_missing' WHEN twice THEN 'anchor_repeated' WHEN s > e THEN 'anchor_order_changed'
  WHEN substr(text, s, e - s) = want THEN 'exact_occurrence_match' ELSE 'occurrence_differs' END AS reason FROM p)
SELECT check_id, CASE reason WHEN 'exact_occurrence_match' THEN 'passed' WHEN 'occurrence_differs' THEN 'failed' WHEN 'empty_candidate_context' THEN 'failed' ELSE 'abstained' END AS status, reason FROM r""")
def context_checks(spark, sf_dir):
    return ocr.context_checks(_checks(spark, sf_dir)).select("check_id", "status", "reason")


def _checks(spark, sf_dir):
    k, t = F.col("doc_id") % 9, F.col("text")
    part = lambda a, n: F.substring(t, a, n)
    left = F.when(k == 1, "").when(k == 2, part(1, 1)).when(k == 3, "#none#").when(k == 4, part(40, 10)).otherwise(part(5, 12))
    right = F.when(k == 0, "").when(k == 4, part(5, 12)).otherwise(part(40, 10))
    want = F.when(k == 5, "other").when(k == 1, part(1, 39)).when(k == 0, F.substr(t, F.lit(17))).otherwise(part(17, 23))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("check_id"), "lang", F.when(k == 7, F.lit(None).cast("string")).when(k == 8, "  ").otherwise(t).alias("text"), left.alias("left_anchor"), right.alias("right_anchor"), want.alias("expected"))


@query("""
WITH c AS (SELECT lang, CASE WHEN doc_id % 9 = 7 THEN 'not_available' WHEN trim(text) = '' OR doc_id % 9 = 8 THEN 'empty' END AS early FROM documents)
SELECT lang, count(*) FILTER (early IS NOT NULL) AS without_text, count(*) AS checks FROM c GROUP BY 1""")
def context_check_totals(spark, sf_dir):
    totals = ocr.check_totals(ocr.context_checks(_checks(spark, sf_dir)).withColumn("status", F.when(F.col("reason").isin("not_available", "empty_candidate_context"), "without_text").otherwise("with_text")), "lang")
    return totals.groupBy("lang").agg(F.coalesce(F.sum(F.when(F.col("status") == "without_text", F.col("n"))), F.lit(0)).alias("without_text"), F.sum("n").alias("checks"))


@query("""
WITH m AS (SELECT o_custkey % 40 AS doc, o_orderkey AS ref, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS page, o_orderkey % 4 AS k FROM orders),
i AS (SELECT doc, ref, page, CASE k WHEN 0 THEN 'page_footer' WHEN 1 THEN 'text' WHEN 2 THEN 'page_header' ELSE 'text' END AS label, page + CASE WHEN ref % 7 = 0 THEN 3 ELSE doc % 5 END AS printed, CASE WHEN k < 2 THEN 'bottom' ELSE 'top' END AS edge, round((ref % 5) * 0.01, 2) AS ratio FROM m),
lab AS (SELECT *, page - printed AS delta FROM i WHERE label IN ('page_footer', 'page_header')),
v AS (SELECT doc, page, min(delta) AS delta FROM lab GROUP BY 1, 2 HAVING count(DISTINCT delta) = 1),
lead_ AS (SELECT doc, delta FROM (SELECT doc, delta, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc) AS total FROM v GROUP BY 1, 2) WHERE n >= 3 AND n * 2 > total),
lane AS (SELECT lab.doc, lab.delta, lab.edge, list_sort(list(lab.ratio)) AS r FROM lab JOIN lead_ USING (doc, delta) GROUP BY 1, 2, 3)
SELECT i.doc, i.ref FROM i JOIN lane ON lane.doc = i.doc AND lane.edge = i.edge AND lane.delta = i.page - i.printed WHERE i.label = 'text' AND abs(i.ratio - lane.r[len(lane.r) // 2 + 1]) <= 0.02""")
def page_number_furniture(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("doc"), F.col("o_orderkey").alias("ref"), (F.col("o_orderkey") % 4).alias("k"))
    pages = own.withColumn("page", F.row_number().over(W.partitionBy("doc").orderBy("ref")))
    label = F.when(F.col("k") == 0, "page_footer").when(F.col("k") == 2, "page_header").otherwise("text")
    items = pages.select("doc", "ref", "page", label.alias("label"), (F.col("page") + F.when(F.col("ref") % 7 == 0, 3).otherwise(F.col("doc") % 5)).alias("printed"), F.when(F.col("k") < 2, "bottom").otherwise("top").alias("edge"), F.round((F.col("ref") % 5) * 0.01, 2).alias("ratio"))
    return ocr.page_number_furniture(items)


@query("""
WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, n_chars // 100 AS page, last_value(n_chars // 100) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents),
o AS (SELECT count(*) FILTER (coalesce(trim(text), '') = '') AS a, count(*) FILTER (page < before) AS b, count(text) - count(DISTINCT lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS c FROM r)
SELECT name, observed, CASE WHEN observed = 0 THEN 'pass' WHEN name = 'canonical_text_duplicates' THEN 'warning' ELSE 'fail' END AS status FROM (
  SELECT 'empty_text' AS name, a AS observed FROM o UNION ALL SELECT 'page_regressions', b FROM o UNION ALL SELECT 'canonical_text_duplicates', c FROM o
  UNION ALL SELECT unnest(['unknown_content_type', 'duplicate_stable_ids', 'missing_stable_ids', 'chunk_index_gaps', 'page_range_reversed']), 0)""")
def record_checks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    page = F.floor(F.col("n_chars") / 100)
    index = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    own = docs.select("source", F.col("doc_id").alias("ord"), index.alias("chunk_index"), F.col("doc_id").alias("stable_id"), "text", F.lit("author_narrative").alias("content_type"), page.alias("page_start"), page.alias("page_end"))
    return quality.record_checks(own)


@query()
def lexical_tokens(spark, sf_dir):
    """Digests of every document's text and source tokens."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return udfs.told_of(docs, udfs.attestation_rows, udfs.ATTESTATION)


@query()
def legal_tokens(spark, sf_dir):
    """How many tokens of the search analyser each document has, and their digest."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", udfs.analysed(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", "\x00"), 256).alias("sha256"))


@query()
def spot_audit_sample(spark, sf_dir):
    """Five documents of each source, drawn by a hash-driven shuffle of the ids that a hash puts first."""
    return corpus.spot_audit(table(spark, sf_dir, "documents"), "source", "doc_id", 5, "audit")


@query()
def contiguous_partition(spark, sf_dir):
    """Each language's sources, in order, in five contiguous parts with the least greatest size."""

    def run(pdf):
        pdf = pdf.sort_values("source").reset_index(drop=True)
        starts = corpus.contiguous_parts(pdf.n_chars.tolist(), min(5, len(pdf)))
        return pdf.assign(part=[sum(s <= i for s in starts) for i in range(len(pdf))])[["lang", "source", "n_chars", "part"]]

    sizes = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("n_chars"))
    return sizes.groupBy("lang").applyInPandas(run, "lang string, source string, n_chars long, part int")
