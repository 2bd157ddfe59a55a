"""JSON-lines and whole-file sources and sinks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import cut

#: The chunk record's declared fields; others are kept in ``raw``.
CHUNK = (
    "text STRING, metadata STRUCT<chunk_index INT, content_type STRING, content_source STRING, section_path STRING, "
    "headings ARRAY<STRING>, chapter_num INT, chapter_title STRING, case_names ARRAY<STRING>, primary_case STRING, "
    "page_start INT, page_end INT, page_range STRING, cross_references ARRAY<STRING>, context STRING, quality_score INT, "
    "token_count INT, embedding_token_count INT, source_file STRING, stable_id STRING, context_parent_id STRING, "
    "previous_stable_id STRING, next_stable_id STRING, retrieval_role STRING, table_parent_stable_id STRING, "
    "table_child_index INT, table_child_count INT, table_rows INT, table_cols INT>"
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ord (1-based, per file) and line: split at LF only, so that U+2028 stays inside a line.

    Files are read in splits, by Spark's own line reader; a line's number is its place among its file's splits and within them.
    """
    from pyspark.sql import Window as W

    raw = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_name", "_metadata.file_block_start")
    rows = cut(raw.withColumn("__at", F.monotonically_increasing_id()))
    within = F.row_number().over(W.partitionBy("file_name", "file_block_start").orderBy("__at"))
    sizes = rows.groupBy("file_name", "file_block_start").agg(F.count("*").alias("__n"))
    ahead = sizes.select("file_name", "file_block_start", F.coalesce(F.sum("__n").over(W.partitionBy("file_name").orderBy("file_block_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = rows.withColumn("__w", within).join(F.broadcast(ahead), ["file_name", "file_block_start"])
    ord_ = F.col("__w") + F.col("__before")
    line = F.when((ord_ == 1) & F.col("value").startswith("\ufeff"), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    return own.select(F.col("file_name").alias("file"), ord_.cast("long").alias("ord"), line.alias("line"))


def strict_json_error(raw: str, depth: int = 64, digits: int = 4300) -> str | None:
    """Why ``raw`` is not one strict JSON object, or None: duplicate keys, NaN, depth and huge numbers are errors."""

    class Refused(ValueError):
        pass

    def pairs(items):
        seen = {}
        for k, v in items:
            if k in seen:
                raise Refused("duplicate_key")
            seen[k] = v
        return seen

    def refuse(_):
        raise Refused("non_finite")

    def whole(text):
        if len(text) > digits:
            raise Refused("huge_integer")
        return int(text)

    def real(text):
        value = float(text)
        if value in (float("inf"), float("-inf")):
            raise Refused("non_finite")
        return value

    level = deepest = 0
    quoted = escaped = False
    for c in raw:
        if quoted:
            quoted, escaped = (True, not escaped) if c == "\\" else (escaped or c != '"', False)
        elif c == '"':
            quoted = True
        elif c in "[{":
            level += 1
            deepest = max(deepest, level)
        elif c in "]}":
            level -= 1
    if deepest > depth:
        return "too_deep"
    try:
        value = json.loads(raw, object_pairs_hook=pairs, parse_constant=refuse, parse_int=whole, parse_float=real)
    except Refused as e:
        return str(e)
    except ValueError:
        return "syntax"
    return None if isinstance(value, dict) else "not_an_object"


def strict_chunks(spark: SparkSession, path: str) -> DataFrame:
    """ord, line, text, metadata and error of every non-blank line; nothing is dropped."""
    @F.pandas_udf("string")
    def problem(raw: pd.Series) -> pd.Series:
        return raw.map(strict_json_error)

    rows = lines(spark, path).where(F.trim("line") != "")
    parsed = rows.withColumn("error", problem("line")).withColumn("p", F.from_json("line", CHUNK))
    missing = F.when(F.coalesce(F.trim("p.text"), F.lit("")) == "", "missing_text").when(F.col("p.metadata").isNull(), "missing_metadata")
    return parsed.select("file", "ord", F.col("p.text").alias("text"), F.col("p.metadata").alias("metadata"), F.coalesce("error", missing).alias("error"), F.col("line").alias("raw"))


def lenient_chunks(spark: SparkSession, path: str) -> DataFrame:
    """ord, text, metadata and error of every line that is not blank: any JSON object with a text and a content type; an empty file is an error."""
    rows = lines(spark, path).where(F.trim("line") != "").withColumn("p", F.from_json("line", CHUNK, {"mode": "PERMISSIVE"})).withColumn("v", F.try_parse_json("line"))
    typed = F.coalesce(F.trim("p.metadata.content_type"), F.lit("")) != ""
    error = F.when(F.col("v").isNull(), "syntax").when(F.col("p.text").isNull(), "missing_text").when(~typed, "missing_content_type")
    if rows.isEmpty():
        raise ValueError("no chunk records: the file is empty or blank")
    return rows.select("file", "ord", F.col("p.text").alias("text"), F.col("p.metadata").alias("metadata"), error.alias("error"))


#: A judged query's declared fields.
QUERY = "query_id STRING, query STRING, tags ARRAY<STRING>, subject STRING, book STRING, difficulty STRING, expect_abstain BOOLEAN, expected_type STRING, corpus STRUCT<sha256 STRING, record_count BIGINT, id_scheme STRING>, judgments ARRAY<STRUCT<chunk_id STRING, source_id STRING, relevance DOUBLE, accepted_children ARRAY<STRING>>>"


def judged_queries(spark: SparkSession, path: str) -> DataFrame:
    """ord, the query's fields and error of every line: strict JSON, a query text, and judgments of an id and a grade of zero or more."""

    @F.pandas_udf("string")
    def problem(raw: pd.Series) -> pd.Series:
        return raw.map(strict_json_error)

    rows = lines(spark, path).where(F.trim("line") != "").withColumn("error", problem("line")).withColumn("q", F.from_json("line", QUERY))
    bad = F.exists(F.coalesce("q.judgments", F.array().cast("array<struct<chunk_id:string,source_id:string,relevance:double,accepted_children:array<string>>>")), lambda j: (F.coalesce(F.trim(j["chunk_id"]), F.trim(j["source_id"]), F.lit("")) == "") | ~F.coalesce(j["relevance"] >= 0, F.lit(False)))
    found = F.when(F.coalesce(F.trim("q.query"), F.lit("")) == "", "missing_query").when(bad, "bad_judgment")
    return rows.select("ord", "q.*", F.coalesce("error", found).alias("error"))


def usage_report(spark: SparkSession, path: str) -> DataFrame:
    """The token counts of a usage report (one JSON file with counts), its digest and error: a count that is missing, or tokens without attempts."""
    names = ["exact_prompt_tokens", "exact_completion_tokens", "estimated_prompt_tokens", "estimated_completion_tokens", "exact_usage_attempts", "estimated_usage_attempts", "unknown_usage_attempts"]
    held = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("report_sha256"), F.from_json(F.decode("content", "UTF-8"), "counts STRUCT<" + ", ".join(f"{n} BIGINT" for n in names) + ">").alias("r"))
    own = held.select("report_sha256", "r.counts.*")
    absent = F.lit(False)
    for n in names:
        absent = absent | F.col(n).isNull() | (F.col(n) < 0)
    loose = lambda kind: (F.col(f"{kind}_usage_attempts") == 0) & (F.col(f"{kind}_prompt_tokens") + F.col(f"{kind}_completion_tokens") > 0)
    error = F.when(absent, "missing_count").when(loose("exact") | loose("estimated"), "tokens_without_attempts")
    return own.select("*", (F.col("exact_prompt_tokens") + F.col("estimated_prompt_tokens")).alias("input_tokens"), (F.col("exact_completion_tokens") + F.col("estimated_completion_tokens")).alias("output_tokens"), error.alias("error"))


def file_snapshots(spark: SparkSession, path: str, most_bytes: int = 1 << 28) -> DataFrame:
    """path, bytes and sha256 of whole files; a file of more than ``most_bytes`` is an error, found before it is read."""
    files = spark.read.format("binaryFile").load(path)
    if files.select("length").where(F.col("length") > most_bytes).limit(1).count():
        raise ValueError(f"a file has more than {most_bytes} bytes")
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines by Spark's own commit protocol (temporary files, then a rename)."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def index_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """The ids of an index table; an error if its size changes while they are read."""
    before = spark.read.parquet(path).count()
    ids = cut(spark.read.parquet(path).select(key))
    if not before == ids.count() == spark.read.parquet(path).count():
        raise RuntimeError("the index changed while its ids were read")
    return ids
