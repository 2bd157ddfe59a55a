"""Queries of the lineage, alignment and table-family operators over lines of the documents, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators import corpus, families, ingest, layout, lineage, records
from corpusmill.plans.catalog import QUERIES, SQL, query
from corpusmill.plans.fixtures import BOXES_SQL as FIXED_BOXES_SQL
from corpusmill.plans.fixtures import CHILDREN_SQL, supplier_tables
from corpusmill.plans.fixtures import _boxes as fixed_boxes
from corpusmill.sources.tables import spread, table

#: Every line of every document as an item: its number, level, and what it does to the headings in force.
LINES_SQL = """lines AS (
  SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), items AS (
  SELECT *, n % 97 = 5 AS resets, CASE WHEN n % 97 <> 5 AND n % 3 = 0 THEN (n // 3) % 9 + 1 END AS level, n % 7 = 0 AS attested,
    n % 3 = 1 AS content, pos // 6 AS page, (n * 37) % 600 AS top
  FROM (SELECT *, length(line) AS n FROM lines)
)"""


def _items(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    own = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos0", "line"))
    n = F.length("line")
    return own.select(
        "doc_id", F.col("pos0").cast("long").alias("pos"), "line", n.alias("n"), (n % 97 == 5).alias("resets"),
        F.when((n % 97 != 5) & (n % 3 == 0), (F.floor(n / 3) % 9 + 1).cast("int")).alias("level"), (n % 7 == 0).alias("attested"),
        (n % 3 == 1).alias("content"), F.floor(F.col("pos0") / 6).cast("long").alias("page"), ((n * 37) % 600).cast("double").alias("top"),
    )


PATHS_SQL = f"""{LINES_SQL}, walked AS (
  SELECT DISTINCT doc_id, -1::BIGINT AS pos, []::STRUCT(l BIGINT, a BIGINT)[] AS st, true AS content, NULL::BIGINT[] AS before FROM items
  UNION ALL
  SELECT doc_id, pos, CASE WHEN resets THEN [] WHEN eff IS NULL THEN st ELSE list_append(list_filter(st, lambda x: x.l < eff), {{'l': eff, 'a': pos}}) END,
    CASE WHEN resets THEN true WHEN eff IS NOT NULL THEN false ELSE now OR was END, CASE WHEN eff IS NOT NULL THEN list_transform(st, lambda x: x.a) END
  FROM (
    SELECT i.doc_id, i.pos, i.resets, i.content AS now, w.content AS was, w.st,
      CASE WHEN NOT w.content AND len(w.st) > 0 AND NOT i.attested THEN greatest(i.level, w.st[-1].l + 1) WHEN i.level IS NOT NULL THEN i.level END
        + CASE WHEN i.level IS NULL THEN NULL ELSE 0 END AS eff
    FROM walked w JOIN items i ON i.doc_id = w.doc_id AND i.pos = w.pos + 1)
), paths AS MATERIALIZED (SELECT doc_id, pos, list_transform(st, lambda x: x.a) AS path, before FROM walked WHERE pos >= 0)"""


@query(f"WITH RECURSIVE {PATHS_SQL} SELECT * FROM paths")
def heading_paths(spark, sf_dir):
    """The headings in force pos every line, nine levels deep, with those before each heading."""
    return lineage.heading_paths(_items(spark, sf_dir), "doc_id", "pos")


@query(f"""
WITH RECURSIVE {PATHS_SQL}, e AS (SELECT doc_id, pos, unnest(path) AS heading, unnest(range(0, len(path))) AS depth FROM paths)
SELECT doc_id, heading, min(depth) AS depth, min(pos) AS first, max(pos) AS last FROM e GROUP BY 1, 2""")
def scope_ends(spark, sf_dir):
    paths = lineage.heading_paths(_items(spark, sf_dir), "doc_id", "pos")
    ends = lineage.scope_ends(paths, "doc_id", "pos")
    return ends.withColumn("depth", F.col("depth").cast("long"))


NODES_SQL = f"""{LINES_SQL}, nodes AS (
  SELECT doc_id AS doc, 'L' || pos AS ref, pos AS place, true AS item, CASE WHEN n % 101 = 0 THEN 'L' || pos WHEN n % 103 = 0 THEN 'none'
    WHEN n % 11 = 0 AND pos > 0 THEN 'L' || (pos - 1) WHEN pos % 5 <> 0 THEN 'G' || (pos // 5) END AS parent FROM items
  UNION ALL
  SELECT doc_id, 'G' || (pos // 5), pos, false, CASE WHEN (pos // 5) % 4 = 1 THEN 'G' || (pos // 5 - 1) END FROM items WHERE pos % 5 = 0
), walk AS (
  SELECT doc, ref, [place] AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.doc, n.ref, list_append(w.path, n.place) FROM walk w JOIN nodes n ON n.doc = w.doc AND n.parent = w.ref
)"""


@query(f"""
WITH RECURSIVE {NODES_SQL} SELECT doc, ref, row_number() OVER (PARTITION BY doc ORDER BY path IS NULL, coalesce(path, [place]), ref) - 1 AS ord
FROM nodes LEFT JOIN walk USING (doc, ref) WHERE item""")
def document_order(spark, sf_dir):
    """Lines below groups of lines, some of these below others, some lines below lines, on cycles or below nothing."""
    i, pos, n = _items(spark, sf_dir), F.col("pos"), F.col("n")
    line, block = F.concat(F.lit("L"), pos.cast("string")), F.floor(pos / 5)
    up = F.when(n % 101 == 0, line).when(n % 103 == 0, "none").when((n % 11 == 0) & (pos > 0), F.concat(F.lit("L"), (pos - 1).cast("string")))
    named = lambda k: F.concat(F.lit("G"), k.cast("string"))
    lines = i.select(F.col("doc_id").alias("doc"), line.alias("ref"), up.when(pos % 5 != 0, named(block)).alias("parent"), pos.alias("place"), F.lit(True).alias("item"))
    groups = i.where(pos % 5 == 0).select(F.col("doc_id").alias("doc"), named(block).alias("ref"), F.when(block % 4 == 1, named(block - 1)).alias("parent"), pos.alias("place"), F.lit(False).alias("item"))
    return lineage.document_order(lines.unionByName(groups))


#: Lines as boxes, eight a page; pages begin below their top, so that they wrap once, and some late lines stand low.
BOXES_SQL = f"""{LINES_SQL}, b AS (
  SELECT doc_id AS doc, pos AS place, n, pos // 8 AS page, (pos % 8 + doc_id) % 8 AS slot, len(string_split(line, ' ')) AS words FROM items
), boxes AS (
  SELECT doc, place, page, slot * 80 + CASE WHEN n % 4 = 1 AND slot < 3 THEN 230 ELSE 0 END AS top, CASE WHEN n % 3 = 0 THEN 250 ELSE 50 END AS left_,
    CASE WHEN n % 3 = 0 THEN 'iv' END AS marker, CASE WHEN n % 13 = 0 THEN 'page_header' WHEN n % 5 = 0 THEN 'section_header' ELSE 'text' END AS label, words,
    doc % 9 = 0 AS structural FROM b
)"""


@query(f"""
WITH {BOXES_SQL}, own AS (
  SELECT *, row_number() OVER p AS i, top + 60 AS bottom, lag(top) OVER p - top >= 245 AND (lag(left_) OVER p = left_ OR marker IS NOT NULL) AS wrap
  FROM boxes WHERE NOT structural AND label <> 'page_header' WINDOW p AS (PARTITION BY doc, page ORDER BY place)
), m AS (
  SELECT *, coalesce(sum(wrap::INT) OVER (PARTITION BY doc, page ORDER BY i), 0) > 0 AS late, coalesce(sum(wrap::INT) OVER g, 0) AS wraps, count(*) OVER g AS size
  FROM own WINDOW g AS (PARTITION BY doc, page)
), r AS (
  SELECT doc, page, max(bottom) FILTER (WHERE late) <= min(top) FILTER (WHERE NOT late) + 4 AS rotates,
    count(*) FILTER (WHERE late) <= 4 AND bool_and(label = 'section_header' OR words <= 16) FILTER (WHERE late) AS inserts FROM m WHERE wraps = 1 AND size >= 4 GROUP BY ALL
), s AS (
  SELECT m.*, rotates, inserts, CASE WHEN NOT late THEN i ELSE coalesce((SELECT min(e.i) FROM m e WHERE e.doc = m.doc AND e.page = m.page AND NOT e.late
    AND (e.top, e.left_, e.place) > (m.top, m.left_, m.place)), size + 1) END AS slot
  FROM m LEFT JOIN r USING (doc, page)
), o AS (
  SELECT doc, page, place, i, row_number() OVER (PARTITION BY doc, page ORDER BY CASE WHEN rotates THEN (NOT late)::INT WHEN inserts THEN slot ELSE 0 END,
    CASE WHEN rotates THEN i WHEN inserts THEN (NOT late)::INT ELSE i END, CASE WHEN inserts AND NOT rotates AND late THEN top ELSE 0 END,
    CASE WHEN inserts AND NOT rotates AND late THEN left_ ELSE 0 END, place) AS k FROM s
)
SELECT o.doc, o.place AS ref, t.place FROM o JOIN o t ON t.doc = o.doc AND t.page = o.page AND t.i = o.k
UNION ALL SELECT doc, place, place FROM boxes WHERE structural OR label = 'page_header'""")
def wrapped_pages(spark, sf_dir):
    """The place of every line after the repair of wrapped pages."""
    pos, n, doc = F.col("pos"), F.col("n"), F.col("doc_id")
    slot = (pos % 8 + doc) % 8
    top = (slot * 80 + F.when((n % 4 == 1) & (slot < 3), 230).otherwise(0)).cast("double")
    left = F.when(n % 3 == 0, 250.0).otherwise(50.0)
    label = F.when(n % 13 == 0, "page_header").when(n % 5 == 0, "section_header").otherwise("text")
    nodes = _items(spark, sf_dir).select(
        doc.alias("doc"), pos.alias("ref"), pos.alias("place"), F.floor(pos / 8).alias("page"), top.alias("top"), (top + 60).alias("bottom"), left.alias("left"),
        (left + 150).alias("right"), label.alias("label"), F.size(F.split("line", " ")).alias("words"), F.when(n % 3 == 0, "iv").alias("marker"),
        F.lit(700.0).alias("page_height"), F.lit(500.0).alias("page_width"), (doc % 9 == 0).alias("structural"),
    )
    return lineage.repaired_places(nodes).select("doc", "ref", "place")


BINDINGS_SQL = f"""{PATHS_SQL}, heads AS MATERIALIZED (
  SELECT p.doc_id, p.pos, p.before, i.page, i.top, lower(trim(i.line)) AS title FROM paths p JOIN items i USING (doc_id, pos) WHERE p.before IS NOT NULL
), risen AS (
  SELECT p.doc_id, p.pos, i.page, i.top, p.path, 0 AS step FROM paths p JOIN items i USING (doc_id, pos) WHERE p.before IS NULL
  UNION ALL
  SELECT r.doc_id, r.pos, r.page, r.top, h.before, r.step + 1 FROM (
    SELECT r.doc_id, r.pos, r.page, r.top, r.step, max(x.pos) AS h
    FROM (SELECT *, unnest(path) AS u FROM risen) r JOIN heads x ON x.doc_id = r.doc_id AND x.pos = r.u AND x.page = r.page AND x.top > r.top + 0.5 GROUP BY ALL
  ) r JOIN heads h ON h.doc_id = r.doc_id AND h.pos = r.h
), final AS MATERIALIZED (SELECT doc_id, pos, arg_max(path, step) AS path FROM risen GROUP BY 1, 2
), spans AS (
  SELECT doc_id, pos // 4 AS record, min(path) AS a, max(path) AS b, min(pos) AS rank FROM final GROUP BY 1, 2
), scopes AS MATERIALIZED (
  SELECT doc_id, record, rank, a <> b AS conflict, a[:coalesce(list_max(list_filter(range(0, len(a) + 1), lambda n: a[:n] = b[:n])), 0)] AS path FROM spans
), each AS (
  SELECT s.doc_id, s.record, s.rank, s.depth, s.heading, h.title
  FROM (SELECT *, unnest(path) AS heading, unnest(range(0, len(path))) AS depth FROM scopes) s JOIN heads h ON h.doc_id = s.doc_id AND h.pos = s.heading
), shown AS (
  SELECT doc_id, record, title, depth AS n FROM each WHERE (heading + record) % 5 <> 0
  UNION ALL SELECT doc_id, record, 'extra ' || record, 99 FROM scopes WHERE record % 7 = 0
), told AS (
  SELECT e.*, EXISTS (SELECT 1 FROM shown x WHERE x.doc_id = e.doc_id AND x.record = e.record AND x.title = e.title) AS bound FROM each e
), owned AS (SELECT doc_id, heading, arg_min(record, (rank, record)) AS owner FROM told WHERE bound GROUP BY 1, 2
), lists AS (
  SELECT doc_id, record, list(heading ORDER BY depth) FILTER (WHERE bound) AS bound, list(heading ORDER BY depth) FILTER (WHERE NOT bound) AS missing,
    list(heading ORDER BY depth) FILTER (WHERE bound AND owner = record) AS direct FROM told LEFT JOIN owned USING (doc_id, heading) GROUP BY 1, 2
), unknown AS (
  SELECT doc_id, record, list(title ORDER BY n, title) AS unbound FROM shown x
  WHERE NOT EXISTS (SELECT 1 FROM each e WHERE e.doc_id = x.doc_id AND e.record = x.record AND e.title = x.title) GROUP BY 1, 2
), bindings AS MATERIALIZED (
  SELECT doc_id, record, conflict, coalesce(bound, []) AS bound, coalesce(missing, []) AS missing, coalesce(direct, []) AS direct, coalesce(unbound, []) AS unbound,
    len(coalesce(missing, [])) = 0 AND len(coalesce(unbound, [])) = 0 AS valid
  FROM scopes LEFT JOIN lists USING (doc_id, record) LEFT JOIN unknown USING (doc_id, record)
)"""


def _bindings(spark, sf_dir):
    items = _items(spark, sf_dir)
    paths = lineage.heading_paths(items, "doc_id", "pos")
    titles = items.select("doc_id", F.col("pos").alias("heading"), F.lower(F.trim("line")).alias("title"))
    refs = items.where("resets or level is null").select("doc_id", F.floor(F.col("pos") / 4).cast("long").alias("record"), "pos")
    scopes = lineage.record_scopes(refs, lineage.risen_paths(items, paths, "doc_id", "pos"), "doc_id", "pos")
    each = scopes.select("doc_id", "record", F.posexplode("path").alias("n", "heading")).join(titles, ["doc_id", "heading"])
    shown = each.where((F.col("heading") + F.col("record")) % 5 != 0).select("doc_id", "record", F.col("title").alias("display"), "n")
    extra = scopes.where("record % 7 = 0").select("doc_id", "record", F.concat(F.lit("extra "), F.col("record").cast("string")).alias("display"), F.lit(99).alias("n"))
    return paths, lineage.heading_bindings(scopes, shown.unionByName(extra), titles, "doc_id")


@query(f"WITH RECURSIVE {BINDINGS_SQL} SELECT * FROM bindings")
def heading_bindings(spark, sf_dir):
    """Records of four lines bound to the headings above them: what they show, miss, show in vain, and claim first."""
    return _bindings(spark, sf_dir)[1]


@query(f"""
WITH RECURSIVE {BINDINGS_SQL}, claimed AS (SELECT doc_id, unnest(direct) AS pos FROM bindings)
SELECT doc_id, pos AS heading FROM heads ANTI JOIN claimed USING (doc_id, pos)""")
def unclaimed_headings(spark, sf_dir):
    paths, bound = _bindings(spark, sf_dir)
    return lineage.unclaimed_headings(paths, bound, "doc_id", "pos")


# --- table families


@query(f"""
WITH {CHILDREN_SQL}, k AS (
  SELECT *, child_index = 0 AND source_key % 5 = 0 AS torn, source_key % 4 = 1 AS orphan, child_index = 1 AND source_key % 3 = 2 AS recounted FROM c
  WHERE total >= 4 AND NOT (child_index = 2 AND source_key % 7 = 3)
), p AS (SELECT stable_id, any_value(child_count) AS n, count(*) AS held FROM k WHERE NOT orphan GROUP BY 1), i AS (
  SELECT stable_id, child_index, unnest([CASE WHEN torn THEN 'invalid_child_table' END, CASE WHEN orphan THEN 'missing_parent' END,
    CASE WHEN torn AND NOT orphan THEN 'child_text_mismatch' END, CASE WHEN recounted AND NOT orphan THEN 'child_count_mismatch' END]) AS issue FROM k
  UNION ALL SELECT stable_id, NULL, unnest(CASE WHEN held < n THEN ['family_child_count_mismatch', 'family_child_indexes_invalid'] ELSE [] END) FROM p
)
SELECT * FROM i WHERE issue IS NOT NULL""")
def table_family_issues(spark, sf_dir):
    """Tables of suppliers by nation with their row children: some torn, some recounted, some missing, some without parents."""
    placed = _families(spark, sf_dir, broken=True)
    found = families.family_audit(placed.drop("part", "family"), of_all=None, of_parent=None)
    return found.join(placed.select("ord", F.col("family").alias("stable_id"), "child_index"), "ord").select("stable_id", "child_index", "issue")


@query(f"""
WITH {CHILDREN_SQL}, k AS (SELECT * FROM c WHERE total >= 4), n AS (SELECT count(*) + count(DISTINCT stable_id) AS n FROM k)
SELECT stable_id AS parent_id, list_sort(list_append(list(stable_id || '#' || child_index), stable_id)) AS members, repeat('0f', 32) AS corpus_sha256, any_value(n) AS record_count, 'suppliers-v1' AS id_scheme
FROM k, n GROUP BY 1""")
def attested_families(spark, sf_dir):
    """The sound families of the same tables, bound to their corpus."""
    return families.attested_families(_families(spark, sf_dir, broken=False).drop("part", "family"), "0f" * 32, "suppliers-v1", of_parent=None, of_all=None)


def _families(spark, sf_dir, broken):
    made = records.with_table_children(supplier_tables(spark, sf_dir), of_parent=None, of_all=None).where("retrieval_role is not null")
    k, i, child = F.regexp_extract("table_parent_stable_id", r"^(\d+)-", 1).cast("int"), F.col("child_index"), F.col("part") == 1
    own = made.withColumns({"k": k, "one": F.lit(1), "cols": F.lit(2)})
    if broken:
        own = own.where(~((k % 4 == 1) & ~child) & ~(F.coalesce(i == 2, F.lit(False)) & (k % 7 == 3)))
    else:
        k = k * 60 + 1  # no rule of those below holds
        own = own.withColumn("stable_id", F.coalesce("stable_id", F.concat_ws("#", "table_parent_stable_id", "child_index")))
    shown = own.select(
        "part", F.col("table_parent_stable_id").alias("family"), "child_index", "stable_id", "retrieval_role", F.lit("table").alias("content_type"),
        F.lit("table").alias("content_source"), F.col("one").alias("schema_version"), F.col("table_parent_stable_id").alias("parent_id"),
        F.when((i == 0) & (k % 5 == 0), "torn").otherwise(F.col("text")).alias("text"), F.lit("f").alias("source_file"),
        (F.col("child_count") + F.when((i == 1) & (k % 3 == 2), 1).otherwise(0)).cast("int").alias("child_count"), F.col("cols").alias("table_cols"),
        F.when(child, 1).otherwise(F.col("child_count")).cast("int").alias("table_rows"), F.coalesce("source_rows", "one").cast("int").alias("source_rows"),
        F.coalesce("source_fragments", "one").cast("int").alias("source_fragments"), F.lit(0).alias("g"),
        F.array(F.struct(F.col("k").cast("string").alias("ref"), F.lit("table").alias("label"))).alias("refs"),
    )
    return corpus.numbered(shown, "g", ["part", "family", "child_index"]).withColumnRenamed("number", "ord").drop("g")


# --- page layout


@query(f"""
WITH {FIXED_BOXES_SQL}, e AS (
  SELECT *, count(*) OVER (PARTITION BY page, line_id) AS lines, count(*) OVER (PARTITION BY page, region_id) AS boxes FROM (
    SELECT r.page, region_id, line_id, (least(n.rr, r.rr) - greatest(n.l, r.l)) * (least(n.b, r.b) - greatest(n.t, r.t)) AS o, (n.rr - n.l) * (n.b - n.t) AS x, (r.rr - r.l) * (r.b - r.t) AS y
    FROM r JOIN n ON r.page = n.page AND least(n.rr, r.rr) > greatest(n.l, r.l) AND least(n.b, r.b) > greatest(n.t, r.t)) WHERE o >= 0.5 * least(x, y)
), s AS (
  SELECT r.page, r.region_id, CASE WHEN max(boxes) IS NULL THEN 'no' WHEN max(boxes) > 1 THEN 'split' WHEN max(lines) > 1 THEN 'merge' WHEN min(o / (x + y - o)) < 0.5 THEN 'weak' ELSE 'one' END AS status, min(line_id) AS box
  FROM r LEFT JOIN e USING (page, region_id) GROUP BY 1, 2
), a AS (
  SELECT page, count(*) AS reference_lines, count(*) FILTER (WHERE status = 'one') AS matched_lines, count(*) FILTER (WHERE status = 'no') AS no_overlap_lines,
    count(*) FILTER (WHERE status = 'split') AS split_candidates, count(*) FILTER (WHERE status = 'weak') AS weak_pairs FROM s GROUP BY 1
), i AS (
  SELECT p.page, count(*) AS order_inversions FROM s p JOIN s q ON q.page = p.page AND q.region_id > p.region_id AND q.box < p.box WHERE p.status = 'one' AND q.status = 'one' GROUP BY 1
), b AS (
  SELECT n.page, count(*) AS observed_boxes, count(*) FILTER (WHERE k > 1) AS merge_candidates, count(*) FILTER (WHERE k IS NULL) AS unmatched_boxes
  FROM n LEFT JOIN (SELECT page, line_id, count(*) AS k FROM e GROUP BY 1, 2) USING (page, line_id) GROUP BY 1
), t AS (SELECT page, COLUMNS(* EXCLUDE page) FROM a FULL JOIN b USING (page))
SELECT page, coalesce(reference_lines, 0) AS reference_lines, coalesce(matched_lines, 0) AS matched_lines, coalesce(no_overlap_lines, 0) AS no_overlap_lines, coalesce(split_candidates, 0) AS split_candidates,
  coalesce(weak_pairs, 0) AS weak_pairs, coalesce(observed_boxes, 0) AS observed_boxes, coalesce(merge_candidates, 0) AS merge_candidates, coalesce(unmatched_boxes, 0) AS unmatched_boxes,
  coalesce(order_inversions, 0) AS order_inversions, coalesce(matched_lines, 0) * (coalesce(matched_lines, 0) - 1) // 2 AS comparable_pairs,
  round(matched_lines / nullif(reference_lines, 0), 6) AS line_recall, round(coalesce(matched_lines, 0) / nullif(observed_boxes, 0), 6) AS box_precision
FROM t LEFT JOIN i USING (page)""")
def stage_counts(spark, sf_dir):
    """Regions of pages against the boxes found there."""
    regions, found = fixed_boxes(spark, sf_dir)
    lines = regions.withColumnRenamed("region_id", "line_id").withColumn("ord", F.col("line_id"))
    out = layout.stage_counts(lines, found.withColumnRenamed("line_id", "box_id"))
    return out.withColumns({c: F.round(c, 6) for c in ("line_recall", "box_precision")})


@query()
def inferred_columns(spark, sf_dir):
    """Lines of documents as pages of two columns, some read across, some with a title, a wide line or a crooked one."""
    i, n = _items(spark, sf_dir), F.col("n")
    k, across = F.col("pos") % 24, F.col("doc_id") % 5 == 0
    row, side = F.when(across, F.floor(k / 2)).otherwise(k % 12), F.when(across, k % 2).otherwise(F.floor(k / 12))
    title = (k == 0) & (n % 4 == 0)
    top = F.when(title, 0).otherwise(200 + row * 30)
    left = side * 300 + 10
    page = F.concat_ws("-", F.col("doc_id").cast("string"), F.floor(F.col("pos") / 24).cast("string"))
    right = left + F.when(title, 500).when(n % 47 == 0, 380).otherwise(200 + n % 30)
    lines = i.select(page.alias("page"), k.alias("line"), F.when(n % 211 != 0, left).alias("left"), top.alias("top"), right.alias("right"), (top + F.when(n % 53 == 0, 45).otherwise(20)).alias("bottom"))
    pages = lines.select("page").distinct().select("page", F.lit(600).alias("width"), F.lit(800).alias("height"))
    return layout.inferred_columns(lines, pages)


CELLS_SQL = """
x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
p AS (SELECT l_orderkey AS tab, k, k AS r, l_suppkey % 3 AS c, 1 + l_partkey % 2 AS rs, 1 + l_suppkey % 2 AS cs, l_returnflag AS t FROM x),
q AS (SELECT l_orderkey AS tab, k, k AS r, l_suppkey % 3 AS c, 1 + l_partkey % 2 AS rs, 1 + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE l_suppkey % 2 END AS cs, CASE WHEN l_partkey % 5 = 0 THEN 'Z' ELSE l_returnflag END AS t FROM x WHERE l_partkey % 11 <> 0)"""


def _cells(spark, sf_dir):
    k = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    own = table(spark, sf_dir, "lineitem").withColumn("k", k)
    span, part = 1 + F.col("l_suppkey") % 2, F.col("l_partkey")
    common = [F.col("l_orderkey").alias("table"), F.col("k").alias("region_id"), F.col("k").alias("row"), (F.col("l_suppkey") % 3).alias("column"), (1 + part % 2).alias("row_span")]
    reference = own.select(*common, span.alias("column_span"), F.col("l_returnflag").alias("text"))
    predicted = own.where(part % 11 != 0).select(*common, F.when(part % 7 == 0, 2).otherwise(span).alias("column_span"), F.when(part % 5 == 0, "Z").otherwise(F.col("l_returnflag")).alias("text"))
    return reference, predicted


@query(f"""
WITH {CELLS_SQL}, g AS (SELECT tab, k, rr, unnest(range(c, c + cs)) AS cc, t FROM (SELECT *, unnest(range(r, r + rs)) AS rr FROM p)),
h AS (SELECT tab, k, rr, unnest(range(c, c + cs)) AS cc, t FROM (SELECT *, unnest(range(r, r + rs)) AS rr FROM q)),
a AS (SELECT tab, rr, cc, min(t) AS a FROM g GROUP BY ALL), b AS (SELECT tab, rr, cc, min(t) AS b FROM h GROUP BY ALL)
SELECT tab AS "table", count(a) AS reference_places, count(*) AS all_places, count(*) FILTER (WHERE a = b) AS agreeing, round(count(*) FILTER (WHERE a = b) / count(*), 6) AS agreement FROM a FULL JOIN b USING (tab, rr, cc) GROUP BY 1""")
def grid_accuracy(spark, sf_dir):
    return layout.grid_accuracy(*_cells(spark, sf_dir)).withColumn("agreement", F.round("agreement", 6))


@query(f"""
WITH {CELLS_SQL}, m AS (SELECT coalesce(p.tab, q.tab) AS tab, p.k AS pk, q.k AS qk, p.cs = q.cs AND p.rs = q.rs AND p.c = q.c AS same FROM p FULL JOIN q ON q.tab = p.tab AND q.k = p.k)
SELECT CASE WHEN tab % 3 = 0 THEN 'calibration' ELSE 'held_out' END AS split, count(*) FILTER (WHERE pk = qk) AS matched_regions, count(*) FILTER (WHERE qk IS NULL) AS missing_regions, count(*) FILTER (WHERE pk IS NULL) AS extra_regions,
  count(pk) AS reference_table_cells, count(*) FILTER (WHERE same) AS correct_table_cells, count(*) FILTER (WHERE pk = qk AND NOT same) AS wrong_table_cells, count(*) FILTER (WHERE qk IS NULL) AS missing_table_cells,
  count(*) FILTER (WHERE pk IS NULL) AS extra_table_cells, round(count(*) FILTER (WHERE same) / count(pk), 6) AS table_cell_accuracy FROM m GROUP BY 1""")
def cell_counts(spark, sf_dir):
    def listed(cells, name):
        cell = F.struct("region_id", "table", "row", "column", "row_span", "column_span")
        return cells.groupBy("table").agg(F.array_sort(F.collect_list("region_id")).alias(name), F.collect_list(cell).alias(f"{name}_cells"))

    reference, predicted = (listed(c, n) for c, n in zip(_cells(spark, sf_dir), ("reference", "prediction")))
    both = reference.join(predicted, "table", "left")
    empty = [F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("prediction", "prediction_cells")]
    split = F.when(F.col("table") % 3 == 0, "calibration").otherwise("held_out")
    return layout.cell_counts(both.select(F.col("table").alias("id"), split.alias("split"), "reference", "reference_cells", *empty)).withColumn("table_cell_accuracy", F.round("table_cell_accuracy", 6))


# --- inspection


@query(f"""
WITH t AS (SELECT content_type, count(*) AS n FROM ({SQL['content_type_classify']}) GROUP BY 1)
SELECT content_type, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM t""")
def content_type_distribution(spark, sf_dir):
    """How many of the texts are of each kind, and their share in percent."""
    counts = QUERIES["content_type_classify"](spark, sf_dir).groupBy("content_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("every"))
    return counts.join(F.broadcast(total), F.lit(True)).select("content_type", "n", F.round(100.0 * F.col("n") / F.col("every"), 6).alias("percent"))


@query("""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'Appendix ' || lang WHEN doc_id % 7 <> 0 THEN (n_chars % 12)::VARCHAR END AS chapter, CASE WHEN doc_id % 4 <> 0 THEN source END AS title FROM documents)
SELECT chapter, count(*) AS n, min(doc_id) AS first_id, arg_min(title, doc_id) FILTER (WHERE title IS NOT NULL) AS title,
  row_number() OVER (ORDER BY TRY_CAST(chapter AS DOUBLE) IS NULL, TRY_CAST(chapter AS DOUBLE), chapter) AS place FROM c WHERE chapter IS NOT NULL GROUP BY 1""")
def chapter_histogram(spark, sf_dir):
    """Records by chapter, numbers before other names, with the first title that stands there."""
    k = F.col("doc_id")
    chapter = F.when(k % 9 == 0, F.concat(F.lit("Appendix "), "lang")).when(k % 7 != 0, (F.col("n_chars") % 12).cast("string"))
    own = table(spark, sf_dir, "documents").select("doc_id", chapter.alias("chapter"), F.when(k % 4 != 0, F.col("source")).alias("title")).where("chapter is not null")
    title = F.min_by("title", F.when(F.col("title").isNotNull(), F.col("doc_id")))
    counts = own.groupBy("chapter").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), title.alias("title"))
    placed = corpus.numbered(counts.withColumns({"g": F.lit(0), "key": ingest.chapter_key(F.col("chapter"))}), "g", ["key"])
    return placed.select("chapter", "n", "first_id", "title", (F.col("number") + 1).alias("place"))
