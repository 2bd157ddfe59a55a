"""Audit of table families: parents, their row children, the source tables they come from, and every rule that they break."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import udfs
from corpusmill.operators.corpus import numbered
from corpusmill.operators.evaluation import family_members
from corpusmill.operators.records import LEAST_ROWS, MOST_CHILDREN, MOST_OF_ALL
from corpusmill.session import cut

#: Version of the family fields; fixed value.
SCHEMA_VERSION = 1
#: What a child shares with its parent; fixed values.
SHARED = [
    "content_type", "content_source", "source_file", "section_path", "chapter_num", "chapter_title", "case_names", "primary_case",
    "page_range", "page_start", "page_end", "cross_references", "headings", "context",
]
PARENT, CHILD = "table_parent", "table_child"
COLUMNS = {
    "ord": "long", "stable_id": "string", "text": "string", "retrieval_role": "string", "content_type": "string", "content_source": "string",
    "schema_version": "int", "parent_id": "string", "child_index": "int", "child_count": "int", "table_rows": "int", "table_cols": "int",
    "source_rows": "int", "source_fragments": "int", "occurrence": "int", "recovered": "boolean", "source_file": "string",
    "page_start": "int", "page_end": "int", "page_range": "string", "refs": "array<struct<ref:string,label:string>>", "malformed": "array<string>",
}


def _fails(c: Column) -> Column:
    """Whether a condition does not hold; null counts as not."""
    return ~F.coalesce(c, F.lit(False))


def _beyond(count: str, most: int | None) -> Column:
    """Whether a count is over a limit; None is no limit."""
    return F.lit(False) if most is None else F.col(count) > most


def parsed_records(records: DataFrame) -> DataFrame:
    """``records`` with all of COLUMNS (missing ones null) and the shared fields, and what their texts hold as tables.

    ``malformed`` names the fields that were not of their type when the record was read; they stand as null.
    """
    own = records.withColumns({c: F.lit(None).cast(kind) for c, kind in COLUMNS.items() if c not in records.columns})
    # a record whose metadata is malformed has no role and is no table
    lost = F.coalesce(F.array_contains("malformed", "metadata"), F.lit(False))
    own = own.withColumns({c: F.when(~lost, F.col(c)) for c in ("retrieval_role", "content_type")})
    child = F.coalesce(F.col("retrieval_role") == CHILD, F.lit(False))
    tabular = F.coalesce((F.col("content_type") == "table") & (F.col("content_source") == "table"), F.lit(False))
    asked = child | tabular | F.coalesce(F.col("retrieval_role") == PARENT, F.lit(False))
    table = udfs.markdown_table(F.when(asked, F.coalesce("text", F.lit(""))))
    named = F.array_distinct(F.transform(F.filter("refs", lambda r: (r["label"] == "table") & (F.length(r["ref"]) > 0)), lambda r: r["ref"]))
    cited = F.array_sort(F.array_distinct(F.transform(F.filter("refs", lambda r: F.length(r["ref"]) > 0), lambda r: r["ref"])))
    one = F.size(named) == 1
    source = F.when(one, F.struct(F.lit("source_ref").alias("kind"), F.coalesce("source_file", F.lit("")).alias("file"), named[0].alias("ref")))
    source = source.otherwise(F.struct(F.lit("record").alias("kind"), F.lit("").alias("file"), F.col("stable_id").alias("ref")))
    told = own.withColumns({"__child": child, "__table": table, "__source": source, "__refs": cited, "__tabular": tabular})
    held = F.col("__table.header").isNotNull()
    schema = F.sha2(F.to_json(F.struct("__table.preamble", "__table.header", "__table.separator", "__table.column_count")), 256)
    return told.withColumns(
        {
            "__primary": ~child & tabular & held,
            "__rows": F.when(held, F.size("__table.rows")),
            "__cols": F.col("__table.column_count"),
            "__schema": schema,
            "__family": F.when(F.length("parent_id") > 0, F.col("parent_id")).otherwise(F.concat(F.lit("\0"), F.col("ord").cast("string"))),
            "__kin": F.coalesce(F.col("retrieval_role").isin(PARENT, CHILD), F.lit(False)),
        }
    )


def _row_issues(first_child: Column, of_parent: int | None) -> Column:
    """Issues that a record shows by itself."""
    role, child, parent = F.col("retrieval_role"), F.col("__child"), F.coalesce(F.col("retrieval_role") == PARENT, F.lit(False))
    kin, primary = F.col("__kin"), F.col("__primary")
    fields = [F.col(c).isNotNull() for c in ("schema_version", "parent_id", "child_index", "child_count", "source_rows", "source_fragments")]
    positive = lambda c: F.col(c) > 0
    bad = lambda c: F.coalesce(F.array_contains("malformed", c), F.lit(False))
    one_row = F.coalesce(F.col("__rows") == 1, F.lit(False))
    checks = {
        "invalid_metadata": bad("metadata"),
        "canonical_record_after_children": ~child & (F.col("ord") > first_child),
        "invalid_table_fragment_occurrence": bad("occurrence") | (F.col("occurrence") < 0),
        "unexpected_table_fragment_occurrence": F.col("occurrence").isNotNull() & ~child & ~primary,
        "invalid_table_recovery_flag": bad("recovered"),
        "orphan_retrieval_fields": role.isNull() & reduce(lambda a, b: a | b, fields),
        "unknown_retrieval_role": role.isNotNull() & ~kin,
        "schema_version_mismatch": kin & _fails(F.col("schema_version") == SCHEMA_VERSION),
        "non_table_retrieval_record": kin & ~F.col("__tabular"),
        "invalid_parent_stable_id": kin & _fails(F.length("parent_id") > 0),
        "invalid_child_count": kin & _fails(positive("child_count")),
        "declared_child_count_exceeds_parent_cap": kin & _beyond("child_count", of_parent),
        "parent_identity_mismatch": parent & _fails(F.col("__family") == F.col("stable_id")),
        "parent_has_child_index": parent & F.col("child_index").isNotNull(),
        "invalid_parent_table": parent & ~primary,
        "parent_table_rows_mismatch": parent & primary & _fails(F.col("table_rows") == F.col("__rows")),
        "parent_table_cols_mismatch": parent & primary & _fails(F.col("table_cols") == F.col("__cols")),
        "invalid_child_index": child & _fails(F.col("child_index") >= 0),
        "invalid_child_table": child & ~one_row,
        "child_table_rows_mismatch": child & one_row & _fails(F.col("table_rows") == 1),
        "child_table_cols_mismatch": child & one_row & _fails(F.col("table_cols") == F.col("__cols")),
        "invalid_table_source_row_count": kin & _fails(positive("source_rows")),
        "invalid_table_source_fragment_count": kin & _fails(positive("source_fragments")),
    }
    # a record without metadata has no other issue
    rest = [F.when(~bad("metadata") & c, F.lit(name)) for name, c in checks.items() if name != "invalid_metadata"]
    return F.array_compact(F.array(F.when(checks["invalid_metadata"], F.lit("invalid_metadata")), *rest))


def _fragment_issues(primary: DataFrame) -> DataFrame:
    """Fragments alike in text and place are numbered from 0 in order; one alone bears no number."""
    alike = F.sha2(F.to_json(F.struct("__source", "text", "source_file", "page_start", "page_end", "page_range", "__refs"), {"ignoreNullFields": "false"}), 256)
    placed = numbered(primary.select("ord", "occurrence", alike.alias("k")), "k", ["ord"])
    wrong = ~F.col("occurrence").eqNullSafe(F.col("number").cast("int"))
    groups = placed.groupBy("k").agg(F.count("*").alias("n"), F.max(wrong).alias("wrong"))
    both = placed.join(groups, "k")
    issue = F.when((F.col("n") > 1) & F.col("wrong"), "table_fragment_occurrences_invalid").when((F.col("n") == 1) & F.col("occurrence").isNotNull(), "unexpected_table_fragment_occurrence")
    return both.select("ord", issue.alias("issue"))


def _source_issues(primary: DataFrame, expanded: DataFrame, least_rows: int, dimensions: DataFrame | None) -> DataFrame:
    """Fragments of one source table agree on its schema, recovery and size, and are parents together if they have rows enough."""
    recovered = F.coalesce("recovered", F.lit(False))
    sources = primary.groupBy("__source").agg(
        F.sum("__rows").alias("rows"), F.count("*").alias("parts"), (F.min("__schema") != F.max("__schema")).alias("schemas"),
        (F.min(recovered) != F.max(recovered)).alias("mixed"), F.max(recovered).alias("any"), F.min("__cols").alias("least"), F.max("__cols").alias("most"),
    )
    if dimensions is None:
        native = sources.withColumns({"native_rows": F.lit(None).cast("int"), "native_cols": F.lit(None).cast("int")})
    else:
        sized = dimensions.select(F.col("ref").alias("__ref"), F.col("rows").alias("native_rows"), F.col("cols").alias("native_cols"))
        known = ~F.col("any") & (F.col("__source.kind") == "source_ref")
        native = sources.join(sized, known & (F.col("__source.ref") == F.col("__ref")), "left").drop("__ref")
    parent = F.coalesce(F.col("retrieval_role") == PARENT, F.lit(False))
    enough = F.col("rows") >= least_rows
    both = primary.select("ord", "__source", "retrieval_role", "source_rows", "source_fragments").join(native, "__source").join(F.broadcast(expanded), F.lit(True))
    checks = {
        "source_table_schema_mismatch": F.col("schemas"),
        "source_table_recovery_mismatch": F.col("mixed"),
        "source_native_row_count_mismatch": F.col("rows") != F.col("native_rows"),
        "source_native_column_count_mismatch": (F.col("least") != F.col("native_cols")) | (F.col("most") != F.col("native_cols")),
        "eligible_source_table_not_expanded": F.col("expanded") & enough & ~parent,
        "ineligible_source_table_expanded": parent & ~enough,
        "source_table_row_count_mismatch": parent & _fails(F.col("source_rows") == F.col("rows")),
        "source_table_fragment_count_mismatch": parent & _fails(F.col("source_fragments") == F.col("parts")),
    }
    return both.select("ord", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("issue"))


def _family_issues(kin: DataFrame, shared: list[str], most_children: int | None) -> DataFrame:
    """One parent a family, with a child for each of its rows, in order, with its fields and the row's text."""
    parent = ~F.col("__child")
    valid = F.col("__child") & (F.col("child_index") >= 0)
    mine = F.sha2(F.to_json(F.struct(*shared), {"ignoreNullFields": "false"}), 256) if shared else F.lit("")
    own = cut(kin.select("ord", "__family", "__child", "child_index", "child_count", "text", "__table", "__rows", "__primary", mine.alias("__shared")))
    placed = numbered(own.where(valid).select("ord", "__family", "child_index"), "__family", ["ord"])
    in_order = placed.groupBy("__family").agg(F.count("*").alias("indexed"), F.max(F.col("child_index") != F.col("number")).alias("disorder"))
    told = own.groupBy("__family").agg(
        F.count(F.when(parent, 1)).alias("parents"), F.count(F.when(F.col("__child"), 1)).alias("children"), F.min(F.when(F.col("__child"), F.col("ord"))).alias("first_child"),
        F.min(F.when(parent, F.col("ord"))).alias("parent"), F.min(F.when(parent, F.col("child_count"))).alias("expected"),
        F.min(F.when(parent, F.col("__shared"))).alias("parent_shared"), F.min(F.when(parent, F.coalesce("__rows", F.lit(-1)))).alias("rows"),
    ).join(in_order, "__family", "left")
    told = cut(told.withColumn("one", (F.col("parents") == 1) & F.coalesce(F.col("expected") > 0, F.lit(False))))
    ordered = (F.coalesce("indexed", F.lit(0)) == F.col("expected")) & _fails(F.col("disorder"))
    of_parent = {
        "family_child_count_mismatch": F.col("one") & (F.col("children") != F.col("expected")),
        "family_child_indexes_invalid": F.col("one") & ~ordered,
        "parent_row_count_mismatch": F.col("one") & (F.col("rows") != F.col("expected")),
    }
    parents = told.select(F.col("parent").alias("ord"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in of_parent.items()]))).alias("issue"))
    both = own.join(told.select("__family", "parents", "children", "first_child", "expected", "parent_shared", "one", "rows"), "__family")
    crowded = _beyond("children", most_children) & F.when(F.col("parents") > 0, parent).otherwise(F.col("ord") == F.col("first_child"))
    of_member = {
        "missing_parent": F.col("parents") == 0,
        "duplicate_parent": F.col("parents") > 1,
        "family_child_count_exceeds_parent_cap": crowded,
        "child_count_mismatch": F.col("one") & F.col("__child") & ~F.col("child_count").eqNullSafe(F.col("expected")),
        "family_metadata_mismatch": F.col("one") & F.col("__child") & (F.col("__shared") != F.col("parent_shared")),
    }
    members = both.select("ord", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in of_member.items()]))).alias("issue"))
    # rows meet the children that stand for them one to one, so that no child carries its whole parent
    whole = told.where("one and rows = expected").select("__family", "expected")
    head = F.concat(F.col("__table.preamble"), F.array("__table.header", "__table.separator"))
    rows = own.where(parent).join(whole.select("__family"), "__family").select("__family", head.alias("h"), F.posexplode("__table.rows").alias("child_index", "r"))
    wanted = rows.select("__family", "child_index", F.sha2(F.array_join(F.concat("h", F.array("r")), "\n"), 256).alias("wanted"))
    own_rows = own.where(valid).join(whole, "__family").where("child_index < expected").select("ord", "__family", "child_index", F.sha2(F.coalesce("text", F.lit("")), 256).alias("found"))
    texts = own_rows.join(wanted, ["__family", "child_index"]).where("found <> wanted").select("ord", F.lit("child_text_mismatch").alias("issue"))
    return parents.unionByName(members).unionByName(texts)


def family_audit(records: DataFrame, least_rows: int = LEAST_ROWS, of_all: int | None = MOST_OF_ALL, dimensions: DataFrame | None = None, of_parent: int | None = MOST_CHILDREN) -> DataFrame:
    """ord and issue of every rule of table families that a record of ``records`` (see COLUMNS; ``ord`` orders them) breaks.

    ``of_all`` and ``of_parent``: children of the corpus and of a parent at most (None: as many as there are).
    ``dimensions``: ref, rows and cols of source tables, where these are known.  Repeated texts and ids are as good as any; an
    empty table has no issues.  Families, sources and alike fragments are grouped by key and numbered over ranges.
    """
    own = cut(parsed_records(records))
    kin, primary = own.where("__kin"), own.where("__primary")
    first = own.where("__child").agg(F.min("ord").alias("__first"))
    single = own.join(F.broadcast(first), F.lit(True)).select("ord", F.explode(_row_issues(F.col("__first"), of_parent)).alias("issue"))
    expanded = kin.agg((F.count("*") > 0).alias("expanded"))
    shared = [c for c in SHARED if c in records.columns]
    parts = [single, _fragment_issues(primary), _source_issues(primary, expanded, least_rows, dimensions), _family_issues(kin, shared, of_parent)]
    if of_all is not None:
        late = numbered(kin.where("__child").select("ord", F.lit(0).alias("g")), "g", ["ord"]).where(F.col("number") >= of_all)
        parts.append(late.select("ord", F.lit("corpus_child_count_exceeds_cap").alias("issue")))
    return reduce(DataFrame.unionByName, parts).where("issue is not null").distinct()


def family_counts(records: DataFrame) -> DataFrame:
    """parent_tables (tables that are no children), expanded_parents and child_chunks of ``records``."""
    role = F.col("retrieval_role")
    tabular = (F.col("content_type") == "table") & (F.col("content_source") == "table")
    n = lambda c: F.count(F.when(c, 1))
    return records.agg(n((role.isNull() & tabular) | (role == PARENT)).alias("parent_tables"), n(role == PARENT).alias("expanded_parents"), n(role == CHILD).alias("child_chunks"))


def attested_families(records: DataFrame, corpus_sha256: str, id_scheme: str, of_parent: int | None = MOST_CHILDREN, of_all: int | None = MOST_OF_ALL) -> DataFrame:
    """parent_id and members of the families of one corpus, with the corpus they are bound to: corpus_sha256, record_count and id_scheme.

    Judgments of table families are only to be held against these (``evaluation.family_issues``).  A corpus that breaks any rule of table
    families has no attestation: the rules that it breaks are named in the error.  For the limits see family_audit.
    """
    if not re.fullmatch("[0-9a-f]{64}", corpus_sha256 or ""):
        raise ValueError("the digest of a corpus is 64 lower-case hex digits")
    if not (id_scheme or "").strip():
        raise ValueError("an id scheme has a name")
    broken = [r.issue for r in family_audit(records, of_parent=of_parent, of_all=of_all).select("issue").distinct().orderBy("issue").collect()]
    if broken:
        raise ValueError("the corpus breaks rules of table families: " + ", ".join(broken))
    members = family_members(records.withColumnRenamed("parent_id", "table_parent_stable_id"))
    counted = records.agg(F.count("*").alias("record_count"))
    return members.join(F.broadcast(counted), F.lit(True)).select("parent_id", "members", F.lit(corpus_sha256).alias("corpus_sha256"), "record_count", F.lit(id_scheme.strip()).alias("id_scheme"))
