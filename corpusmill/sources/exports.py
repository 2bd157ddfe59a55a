"""Sinks and exports: grouped project files, book Markdown, study files, reports and storage."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators.corpus import contiguous_parts
from corpusmill.operators.ingest import file_order

#: Headings are nested no deeper than this many signs; fixed value.
DEEPEST_HEADING = 6


def project_groups(files: DataFrame, most_files: int | None = None) -> DataFrame:
    """project, part, first, last, names and text: a project's files (project, name, text) in their order, in at most ``most_files`` contiguous parts.

    Parts are as even in bytes as can be; files within one are set apart by a rule, and their footnotes are numbered on.  A
    task takes one project, whose files are few.
    """
    ordered = files.select("project", "name", "text", file_order(F.col("name")).alias("place"))
    kind = dict(files.dtypes)["project"]

    def run(pdf):
        import re

        pdf = pdf.assign(part_=[p["part"] for p in pdf.place], number=[p["number"] for p in pdf.place]).sort_values(["part_", "number"])
        if pdf.name.duplicated().any() or pdf[["part_", "number"]].duplicated().any():
            raise ValueError("a project's files are named twice")
        texts, names = pdf.text.tolist(), pdf.name.tolist()
        n = len(texts) if most_files is None else min(most_files, len(texts))
        starts = contiguous_parts([len(t.encode("utf-8")) for t in texts], n)
        out = []
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(texts)])):
            parts, before = [], 0
            for t in texts[a:b]:
                labels = set(re.findall(r"\[\^(\d+)\]", t))
                parts.append(re.sub(r"\[\^(\d+)\]", lambda m, k=before: f"[^{int(m[1]) + k}]", t).rstrip("\n"))
                before += len(labels)
            out.append((pdf.project.iloc[0], i, names[a], names[b - 1], names[a:b], "\n\n---\n\n".join(parts).strip() + "\n"))
        return pd.DataFrame(out, columns=["project", "part", "first", "last", "names", "text"])

    return ordered.groupBy("project").applyInPandas(run, f"project {kind}, part int, first string, last string, names array<string>, text string")


def heading_line(title: Column, level: Column, kind: Column) -> Column:
    """A contents row as a Markdown heading; cases are set in italics."""
    clean = F.regexp_replace(X.stripped(title), "[�\b]", "")
    signs = F.repeat(F.lit("#"), F.least(level + 1, F.lit(DEEPEST_HEADING)).cast("int"))
    return F.concat(signs, F.lit(" "), F.when(kind == "case", F.concat(F.lit("*"), clean, F.lit("*"))).otherwise(clean))


def book_markdown(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """book and text: each granted contents row's heading and the text of its pages, in contents order; front matter is left out.

    ``entries``: book, ord, level, kind, title, start_page, end_page, granted; ``pages``: book, page, text.  Bodies are joined page by
    page before a book's rows meet.
    """
    own = entries.where("kind <> 'front_matter'")
    held = own.where("granted").select("book", "ord", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    bodies = held.join(pages, ["book", "page"]).groupBy("book", "ord").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p")).select("book", "ord", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("body"))
    blocks = own.join(bodies, ["book", "ord"], "left").select("book", "ord", F.concat_ws("\n\n", heading_line(F.col("title"), F.col("level"), F.col("kind")), F.when(X.stripped(F.col("body")) != "", F.col("body"))).alias("block"))
    return blocks.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]), "\n\n").alias("text"))


def flashcards(records: DataFrame) -> DataFrame:
    """line: front, back and tags of study cards (front, back, tags) as one tab-separated line each, tabs and line ends as spaces."""
    flat = lambda c: X.one_spaced(F.coalesce(c, F.lit("")))
    return records.where(X.stripped(F.col("front")) != "").select(F.concat_ws("\t", flat(F.col("front")), flat(F.col("back")), flat(F.array_join("tags", " "))).alias("line"))


def plain_with_sidecar(records: DataFrame, group: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(group, text) of the records' texts in order, a blank line apart, and (group, order, start, end) of each one's characters in it."""
    rows = records.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("text").alias("text")))).alias("r"))
    texts = rows.select(group, F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"))
    from pyspark.sql import Window as W

    ends = F.sum(F.length("text") + 2).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - 2
    return texts, records.select(group, order, (ends - F.length("text")).alias("start"), ends.alias("end"))


def write_report(payload: dict, df: DataFrame, path: str) -> None:
    """One JSON object, ``payload`` and the rows of a small result ``df`` (metrics), by Spark's commit protocol."""
    spark = df.sparkSession
    rows = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("rows")).select(F.concat(F.lit(json.dumps(payload, sort_keys=True)[:-1] + (", " if payload else "") + '"metrics": '), F.coalesce("rows", F.lit("[]")), F.lit("}")).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)
    del spark


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines; what stands there stays."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def storage(spark: SparkSession, path: str) -> DataFrame:
    """bytes and file_count of all files below a path; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("file_count"))
