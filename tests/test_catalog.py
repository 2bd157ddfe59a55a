"""Every registered query against its DuckDB twin."""

import itertools
import math
import os

import duckdb
import pytest

from corpusmill.plans import fixtures, rules, structure  # noqa: F401  these register their queries
from corpusmill.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in SQL:
        assert len(got) > 0
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == sorted(df.columns)
    mine, theirs = rows(df.columns, got), rows(names, want)
    assert len(mine) == len(theirs)
    assert mine == theirs


@pytest.mark.parametrize("name", ["table_children", "table_family_union", "table_family_issues", "attested_families"])
def test_tables_of_many_suppliers(spark, tmp_path, name):
    """More children of a parent, and in all, than the limits of the operators' defaults."""
    home = str(tmp_path)
    many = spark.range(1, 10_501).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "CAST(id % 25 AS INT) AS s_nationkey", "0.0D AS s_acctbal")
    many.toPandas().to_parquet(f"{home}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{home}/supplier.parquet'")
    df = QUERIES[name](spark, home)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    assert len(want) > 70 and rows(df.columns, df.collect()) == want


@pytest.mark.parametrize("name", ["bm25_metadata_topk", "bm25_okapi_topk"])
def test_scores_that_differ_by_their_order_of_addition_are_ties(spark, tmp_path, name):
    """Words in over half the documents weigh alike, so permuted counts give one score, whose last bits differ."""
    counts = list(itertools.permutations((1, 2, 4, 6, 9)))[::7]
    words = ["the", "thing", "and", "thation", "of"]
    texts = [" ".join([w for w, n in zip(words, own) for _ in range(n)] + [f"q{chr(97 + i % 26)}{'xyz'[i // 26]}{chr(97 + j)}" for j in range(20)]) for i, own in enumerate(counts + counts[::-1])]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    assert len(want) > 10 and rows(df.columns, df.collect()) == want


def test_metadata_search_of_odd_rows(spark, duck, tmp_path):
    """A null text or field leaves nothing to be found; a field that repeats another, or is long, counts whole."""
    odd = "CASE WHEN doc_id % 20 = 1 THEN NULL WHEN doc_id % 20 = 2 THEN 'DE' WHEN doc_id % 20 = 3 THEN repeat('the thing of ', 300) ELSE source END"
    duck.execute(f"COPY (SELECT doc_id, CASE WHEN doc_id % 20 > 0 THEN text END AS text, CASE WHEN doc_id % 20 <> 4 THEN lang END AS lang, {odd} AS source, n_chars FROM documents) TO '{tmp_path}/documents.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    df = QUERIES["bm25_metadata_topk"](spark, str(tmp_path))
    cursor = con.execute(SQL["bm25_metadata_topk"])
    names = [d[0] for d in cursor.description]
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())
