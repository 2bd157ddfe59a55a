"""Quality checks over chunk records and the receipt that binds gate evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators.corpus import in_ranges, numbered
from corpusmill.operators.ingest import footer_kinds

#: Content types a record may have; fixed values.
CONTENT_TYPES = ["author_narrative", "case_opinion", "chapter_introduction", "empty", "figure", "footnote", "notes_and_questions", "problem_hypothetical", "statutory_excerpt", "structural", "table"]
#: Checks that only warn.
WARNINGS = ["canonical_text_duplicates"]


def record_checks(records: DataFrame) -> DataFrame:
    """name, observed and status (pass, warning, fail) over (source, ord, chunk_index, stable_id, text, content_type, page_start, page_end).

    One aggregation pass; page order is looked at within each source.
    """
    own = numbered(records, "source", ["ord"], lasts={"__before": F.col("page_start")}).withColumnRenamed("number", "__index")
    n = lambda c: F.count(F.when(c, 1))
    observed = {
        "empty_text": n(F.coalesce(F.trim("text"), F.lit("")) == ""),
        "unknown_content_type": n(~F.coalesce(F.col("content_type").isin(CONTENT_TYPES), F.lit(False))),
        "duplicate_stable_ids": F.count("stable_id") - F.countDistinct("stable_id"),
        "missing_stable_ids": n(F.col("stable_id").isNull()),
        "chunk_index_gaps": n(~F.col("chunk_index").eqNullSafe(F.col("__index"))),
        "page_range_reversed": n(F.col("page_end") < F.col("page_start")),
        "page_regressions": n(F.col("page_start") < F.col("__before")),
        "canonical_text_duplicates": F.count("text") - F.countDistinct(F.sha2(X.canonical(F.col("text")), 256)),
    }
    rows = own.agg(*[c.cast("long").alias(k) for k, c in observed.items()]).unpivot([], list(observed), "name", "observed")
    return rows.withColumn("status", F.when(F.col("observed") == 0, "pass").when(F.col("name").isin(WARNINGS), "warning").otherwise("fail"))


#: Source kinds a record may have; fixed values.
CONTENT_SOURCES = ["body", "figure", "footnote", "mixed", "table"]
#: Checks that must observe as many as there are records; all others but the first must observe none.
COMPLETE = ["unique_stable_ids", "raw_token_counts_present", "embedding_counts_present"]
WARN_ONLY = ["canonical_text_duplicates", "substantive_excluded_page_footers"]


def lineage_issues(records: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """Rows behind each check of source lineage: records (ord, refs: array of ref and sha256) against items (ref, label, sha256, eligible)."""
    cited = records.select("ord", F.explode("refs").alias("r")).select("ord", "r.ref", F.col("r.sha256").alias("told"))
    used = cited.select("ref").distinct()
    missing = items.where("eligible").join(used, "ref", "left_anti")
    return {
        "chunks_have_source_lineage": records.where(F.coalesce(F.size("refs"), F.lit(0)) <= 0).select("ord"),
        "eligible_source_items_represented": missing.select("ref"),
        "source_refs_resolve": used.join(items.select("ref"), "ref", "left_anti"),
        "source_lineage_matches_source": cited.join(items.select("ref", "sha256"), "ref").where("not told <=> sha256").select("ord", "ref"),
        "source_tables_represented": missing.where("label = 'table'").select("ref"),
    }


def classified(content_type: Column, content_source: Column) -> dict[str, Column]:
    """What contradicts itself in a record's type and source kind."""
    kind = lambda k: (content_source == k) & ~content_type.eqNullSafe(F.lit(k))
    return {"missing_content_type": F.coalesce(content_type, F.lit("")) == "", "unknown_content_source": ~F.coalesce(content_source.isin(CONTENT_SOURCES), F.lit(False)), "table_source_mismatch": kind("table"), "footnote_source_mismatch": kind("footnote"), "figure_source_mismatch": kind("figure")}


def entities(case_names: Column, primary_case: Column) -> dict[str, Column]:
    """Case names that are none, and a primary case that is not the first of them."""
    proper = lambda n: (F.length(n) <= 160) & (F.contains(n, F.lit(" v. ")) | n.startswith("In re ") | n.startswith("Ex parte "))
    names = F.coalesce(case_names, F.array().cast("array<string>"))
    return {"invalid_case_names": case_names.isNull() | F.exists(names, lambda n: ~proper(n)), "primary_case_mismatch": ~primary_case.eqNullSafe(F.try_element_at(names, F.lit(1)))}


def tables_sound(text: Column, content_source: Column, rows: Column, columns: Column) -> dict[str, Column]:
    own = content_source == "table"
    return {"missing_markdown_table": own & ~X.rlike(text, r"^\s*\|", "m"), "invalid_row_count": own & ~F.coalesce(rows >= 1, F.lit(False)), "invalid_column_count": own & ~F.coalesce(columns >= 1, F.lit(False))}


def quality_report(records: DataFrame, items: DataFrame, ranges: DataFrame, footers: DataFrame, embedding_limit: int) -> DataFrame:
    """name, observed, required and status (pass, warning, fail) of the checks on a corpus.

    ``records``: source, ord, chunk_index, stable_id, chunk_hash, text, content_type, content_source, page_start, page_end,
    token_count, embedding_token_count, case_names, primary_case, table_rows, table_cols, previous_id, next_id, refs; ``items`` as in
    lineage_issues; ``ranges``: source, start_page, end_page of structural pages; ``footers``: doc, ref, text.  What concerns
    one record is counted in one pass; places and neighbours come from range-dealt numbering, not from a task a source.
    """
    valid = F.coalesce((F.col("page_start") >= 1) & (F.col("page_start") <= F.col("page_end")), F.lit(False))
    placed = numbered(records, "source", ["ord"], lasts={"__page": F.when(valid, F.col("page_start")), "__id": F.col("stable_id")})
    n = lambda c: F.count(F.when(c, 1))
    several = lambda rules: sum((n(c) for c in rules.values()), F.lit(0))
    broken = X.normalisation_issues(F.col("text"), F.col("content_source"), F.size("refs") > 0)
    text_key = F.when(X.fingerprint(F.col("text")) != "", F.sha2(X.fingerprint(F.col("text")), 256))
    local = {
        "nonempty_corpus": F.count("*"),
        "unique_stable_ids": F.countDistinct(F.when(F.col("stable_id") != "", F.col("stable_id"))),
        "valid_chunk_hashes": n(~F.coalesce(F.col("chunk_hash").rlike("^[0-9a-f]{16,64}$"), F.lit(False))),
        "page_metadata_valid": n(~valid),
        "page_regressions": n(valid & (F.col("page_start") < F.col("__page"))),
        "contiguous_chunk_indexes": n(~F.col("chunk_index").eqNullSafe(F.col("number"))),
        "retrieval_linkage_invariants": n(F.coalesce(F.col("previous_id"), F.lit("")) != F.coalesce(F.col("__id"), F.lit(""))),
        "normalization_invariants": F.sum(F.size(broken)),
        "raw_token_counts_present": n(F.col("token_count") >= 0),
        "embedding_counts_present": n(F.col("embedding_token_count") >= 0),
        "embedding_limit": n(F.col("embedding_token_count") > embedding_limit),
        "known_content_types": F.countDistinct(F.when(~F.coalesce(F.col("content_type"), F.lit("")).isin(CONTENT_TYPES), F.coalesce(F.col("content_type"), F.lit("")))),
        "classification_invariants": several(classified(F.col("content_type"), F.col("content_source"))),
        "entity_invariants": several(entities(F.col("case_names"), F.col("primary_case"))),
        "table_invariants": several(tables_sound(F.col("text"), F.col("content_source"), F.col("table_rows"), F.col("table_cols"))),
    }
    one = placed.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in local.items()])
    rows = one.unpivot([], list(local), "name", "observed")
    alone = lambda name, df: df.agg(F.count("*").alias("observed")).select(F.lit(name).alias("name"), "observed")
    leaks = in_ranges(records.where(valid).select("source", "ord", F.col("page_start").alias("page"), "page_end"), ranges.withColumnRenamed("end_page", "__end").withColumn("end_page", F.col("__end")), "source").where("page_end <= __end").select("source", "ord").distinct()
    used = records.select(F.explode("refs.ref").alias("ref")).distinct()
    risky = footer_kinds(footers).where("kind = 'substantive'").select("ref").distinct().join(used, "ref", "left_anti")
    groups = records.select(text_key.alias("k")).where("k is not null").groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
    others = lineage_issues(records, items) | {"structural_ranges_excluded": leaks, "canonical_text_duplicates": groups, "substantive_excluded_page_footers": risky}
    for name, df in others.items():
        rows = rows.unionByName(alone(name, df))
    total = records.agg(F.count("*").alias("__all"))
    own = rows.join(F.broadcast(total), F.lit(True)).withColumn("required", F.when(F.col("name").isin(COMPLETE), F.col("__all")).otherwise(0))
    good = F.when(F.col("name") == "nonempty_corpus", F.col("observed") > 0).otherwise(F.col("observed") == F.col("required"))
    return own.select("name", "observed", "required", F.when(good, "pass").when(F.col("name").isin(WARN_ONLY), "warning").otherwise("fail").alias("status"))


def receipt(gates: DataFrame, domain: str = "corpusmill.gates.v1") -> DataFrame:
    """root, complete and n_gates of (gate, evidence_sha256, passed): a domain-separated digest of the sorted gate lines."""
    line = F.concat_ws(":", "gate", "evidence_sha256", F.when(F.col("passed"), "pass").otherwise("fail"))
    own = gates.agg(F.sort_array(F.collect_list(line)).alias("lines"), F.bool_and("passed").alias("complete"), F.count("*").alias("n_gates"))
    return own.select(F.sha2(F.concat(F.lit(domain + "\x00"), F.array_join("lines", "\n")), 256).alias("root"), "complete", "n_gates")
