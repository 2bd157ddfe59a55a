"""Operators against brute force on small fixtures."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import constants as C
from corpusmill.functions import udfs
from corpusmill.operators import corpus, evaluation, records, retrieval
from corpusmill.sources import jsonl
from corpusmill.streaming import events


def test_search_tokens():
    assert udfs.search_tokens("Fed. R. Civ. P. 12(b)(6) and 326 U.S. 310, $75,000.50; re-\nmand") == ["rule", "12", "b", "6", "and", "326", "us", "310", "75000.50", "remand", "12(b)(6)", "326_us_310", "usd_75000_50"]
    assert udfs.search_tokens("28 U.S.C. § 1331; title 42 of the United States Code") == ["28", "usc", "section", "1331", "42", "usc"]
    assert udfs.search_tokens(None) == []


def test_markdown_tables():
    assert udfs.table_cells(r"| a\|b | c |") == [r"a\|b", "c"]
    assert udfs.table_cells(r"| a\\| c |") == [r"a\\", "c"]
    assert udfs.table_cells("a | b") is None
    good = udfs.parse_table("Cap\n\n| a | b |\n|:---|---:|\n| 1 | 2 |")
    assert good == {"preamble": ["Cap"], "header": "| a | b |", "separator": "|:---|---:|", "rows": ["| 1 | 2 |"], "column_count": 2}
    for bad in ("", "x", "| a |\n|---|", "| a | b |\n|---|---|\n| 1 |", "| a |\n|---|\n| 1 |\ntext", "| a |\n|---|\n|---|"):
        assert udfs.parse_table(bad) is None


def test_edits_and_inversions():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (rng.choices("abc", k=rng.randint(0, 8)) for _ in "ab")
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, old = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(old[j - 1] + (x != y), old[j] + 1, d[-1] + 1))
        s, i, r = udfs.edit_counts(a, b)
        assert s + i + r == d[-1] and len(b) - len(a) == i - r
        order = rng.choices(range(9), k=12)
        assert udfs.inversion_count(order) == sum(order[i] > order[j] for i in range(12) for j in range(i, 12))


def test_nearby_lines():
    assert udfs.nearby_lines("a\nb\na\n|x|\n|x|\n\n\na") == "a\nb\n|x|\n|x|\n\n\na"
    assert udfs.nearby_lines("a\n1\n2\n3\n4\na") == "a\n1\n2\n3\n4"
    assert udfs.nearby_lines("a\n1\n2\n3\n4\n5\na").endswith("5\na")


def okapi(docs, queries):
    import re

    toks = {d: re.findall(C.WORD, t.lower()) or ["__none__"] for d, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for ts in toks.values() for t in set(ts))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    out = {}
    for q, text in queries:
        for d, ts in toks.items():
            asked = re.findall(C.WORD, text.lower())
            if set(asked) & set(ts):
                tf = Counter(ts)
                out[q, d] = sum(idf[t] * tf[t] * (C.K1 + 1) / (tf[t] + C.K1 * (1 - C.B + C.B * len(ts) / avg)) for t in asked if t in tf)
    return out


def test_okapi_with_empty_documents_and_repeats(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices(["ab", "cd", "ef", "gh", "it's", "4.5"], weights=[9, 4, 2, 1, 1, 1], k=rng.randint(0, 9)))) for i in range(40)]
    queries = [(1, "ab ab gh"), (2, "ef it's 4.5"), (3, "zz")]
    want = okapi(docs, queries)
    got = retrieval.bm25_okapi(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id int, query string"), None).collect()
    assert {(r.query_id, r.doc_id) for r in got} == set(want)
    assert all(math.isclose(r.score, want[r.query_id, r.doc_id], rel_tol=1e-9, abs_tol=1e-9) for r in got)


def test_fusion_golden(spark):
    one = spark.createDataFrame([(1, 1, "b"), (1, 2, "a")], "query_id int, rank int, doc_id string")
    two = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id int, rank int, doc_id string")
    got = {r.doc_id: r.score for r in retrieval.rank_fusion([(one, 1.0), (two, 3.0)], k=60).collect()}
    assert math.isclose(got["a"], 1 / 62 + 3 / 61) and math.isclose(got["b"], 1 / 61 + 3 / 62)
    for bad in ([(one, -1.0)], [(one, 0.0)], [(one, float("nan"))], []):
        try:
            retrieval.rank_fusion(bad)
        except ValueError:
            continue
        raise AssertionError("weights must be refused")


def test_grading_credits_a_judgment_once(spark):
    hits = spark.createDataFrame([(1, 1, "child"), (1, 2, "parent"), (1, 3, "x"), (1, 4, "other")], "query_id int, rank int, doc_id string")
    qrels = spark.createDataFrame([(1, "parent", 2.0), (1, "other", 1.0), (1, "gone", 1.0)], "query_id int, doc_id string, relevance double")
    aliases = spark.createDataFrame([(1, "parent", "child")], "query_id int, judged_id string, doc_id string")
    graded = evaluation.graded(hits, qrels, aliases)
    assert [r.relevance for r in graded.orderBy("rank").collect()] == [2.0, 0.0, 0.0, 1.0]
    m = evaluation.query_metrics(graded, qrels, (1, 4)).first()
    assert math.isclose(m.average_precision, (1 + 2 / 4) / 3) and m.mrr == 1 and math.isclose(m.recall_at_4, 2 / 3)
    assert math.isclose(m.ndcg_at_4, (3 + 1 / math.log2(5)) / (3 + 1 / math.log2(3) + 1 / math.log2(4)))


def test_first_kept_is_greedy(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdefgh") for _ in range(rng.randint(2, 60))]
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice("abcdefgh")
            texts.append("".join(own))
    rng.shuffle(texts)
    texts += ["", "a", "A!", texts[0].upper()]
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in (x.lower().replace("!", "") for x in texts)]
    sizes = [len(t.replace("!", "")) for t in texts]
    kept = []
    for i, g in enumerate(grams):
        if not any(g and grams[j] and abs(sizes[i] - sizes[j]) <= 0.2 * max(sizes[i], sizes[j]) and len(g & grams[j]) >= 0.7 * len(g | grams[j]) for j in kept):
            kept.append(i)
    got = corpus.first_kept(spark.createDataFrame(list(enumerate(texts)), "ord int, text string"), 0.7)
    assert sorted(r.ord for r in got.where("kept").collect()) == kept


def test_parts_and_samples():
    from itertools import combinations

    rng = random.Random(3)
    for _ in range(60):
        w = [rng.randint(1, 9) for _ in range(rng.randint(1, 8))]
        g = rng.randint(1, len(w))
        best = min((max(sum(w[a:b]) for a, b in zip((0, *c), (*c, len(w)))), (0, *c)) for c in combinations(range(1, len(w)), g - 1))
        assert tuple(corpus.contiguous_parts(w, g)) == best[1]
    a = corpus.spot_sample(range(100), 10, "s")
    assert a == corpus.spot_sample(range(100), 10, "s") and len(set(a)) == 10 and a != corpus.spot_sample(range(100), 10, "t")


def test_strict_jsonl(spark, tmp_path):
    good = {"text": "a b", "metadata": {"chunk_index": 1}}
    path = tmp_path / "chunks.jsonl"
    path.write_text("﻿" + json.dumps(good, ensure_ascii=False) + '\n\n{"text": "x", "text": "y", "metadata": {}}\n{"text": "", "metadata": {}}\n{"text": "x"}\n[1]\n{"a": NaN}\n{', encoding="utf-8")
    rows = jsonl.strict_chunks(spark, str(path)).orderBy("ord").collect()
    assert [(r.ord, r.error) for r in rows] == [(1, None), (3, "duplicate_key"), (4, "missing_text"), (5, "missing_metadata"), (6, "not_an_object"), (7, "non_finite"), (8, "syntax")]
    assert rows[0].text == "a b"
    assert jsonl.strict_json_error("[" * 65 + "]" * 65) == "too_deep"
    jsonl.write_jsonl(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_streams(spark, tmp_path, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value", "props")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"))
    fold = events.stage_fold(stream).writeStream.format("memory").queryName("fold").outputMode("complete").trigger(availableNow=True).start()
    fold.awaitTermination(120)
    got = {r.event_type: (r.n, r.latest) for r in spark.table("fold").collect()}
    want = {r.event_type: (r.n, r.latest) for r in events.stage_fold(source).collect()}
    assert got == want
    days = events.tumbling(stream).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    days.awaitTermination(120)
    assert spark.table("days").agg(F.sum("n")).first()[0] == source.count()


def test_job_states(spark, tmp_path):
    steps = [("a", 1, "queued"), ("a", 2, "running"), ("a", 3, "succeeded"), ("a", 4, "running"), ("b", 1, "queued"), ("b", 2, "failed")]
    spark.createDataFrame(steps, "job_id string, sequence long, status string").coalesce(1).write.parquet(str(tmp_path / "jobs"))
    stream = spark.readStream.schema("job_id string, sequence long, status string").parquet(str(tmp_path / "jobs"))
    run = events.illegal_steps(stream).writeStream.format("memory").queryName("illegal").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("illegal").collect())) == [("a", 4, "succeeded", "running"), ("b", 2, "queued", "failed")]


def test_index_merge(spark, tmp_path):
    merge = events.merge_index(str(tmp_path / "index"))
    batch = lambda rows: spark.createDataFrame(rows, "id int, hash string, version int")
    merge(batch([(1, "a", 1), (1, "b", 2), (2, "c", 1)]), 0)
    merge(batch([(2, "d", 2), (3, "e", 1)]), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "index/v1")).collect())) == [(1, "b"), (2, "d"), (3, "e")]


def test_identity():
    import hashlib

    from corpusmill.functions import identity

    record = {"text": "é", "metadata": {"chunk_index": 3, "page_start": 1, "page_end": 2, "page_range": "1-2", "source_file": "f", "source_items": [{"ref": "#b"}, {"ref": "#a"}, {"ref": "#a"}, {}]}}
    want = '{"page_end":2,"page_range":"1-2","page_start":1,"source_file":"f","source_refs":["#a","#b"],"text":"é"}'
    assert identity.stable_id(record) == "chunk_" + hashlib.sha256(want.encode()).hexdigest()[:16]
    moved = {"text": "é", "metadata": record["metadata"] | {"chunk_index": 9}}
    assert identity.content_hash(moved) == identity.content_hash(record)
    bound = {"text": "é", "metadata": record["metadata"] | {"stable_id_source": {"name": "n", "size": 1, "sha256": "0" * 64}}}
    assert identity.stable_id(bound) == identity.stable_id(bound | {"metadata": bound["metadata"] | {"source_file": "g", "page_range": "x"}}) != identity.stable_id(record)
    for bad in ({"name": "a/b", "size": 1, "sha256": "0" * 64}, {"name": "a", "size": True, "sha256": "0" * 64}, {"name": "a", "size": 1, "sha256": "X"}):
        try:
            identity.stable_id({"text": "", "metadata": {"stable_id_source": bad}})
        except ValueError:
            continue
        raise AssertionError(bad)


def test_ordinals():
    from corpusmill.functions.identity import ordinal

    assert [ordinal(x) for x in ("7", "007", "XIV", "iv", "IIII", "Twenty  One", "thirty-nine", "fifty", "fifty-one", "51", "0", "", None, "x1")] == [7, 7, 14, 4, None, 21, 39, 50, None, None, None, None, None, None]
    assert ordinal("IV", ("arabic",)) is None


def test_receipt_and_outcomes(spark):
    from corpusmill.operators import ocr, quality

    gates = spark.createDataFrame([("b", "1", True), ("a", "2", True)], "gate string, evidence_sha256 string, passed boolean")
    one, two = quality.receipt(gates).first(), quality.receipt(gates.orderBy("gate")).first()
    assert one == two and one.complete and quality.receipt(gates.withColumn("passed", F.col("gate") == "a")).first().root != one.root
    a = spark.createDataFrame([(1, 3, 3), (2, 3, 3), (3, 3, 3), (4, 3, 3)], "id int, x int, y int")
    b = spark.createDataFrame([(1, 3, 3), (2, 2, 3), (3, 3, 4), (4, 2, 4)], "id int, x int, y int")
    assert [r.outcome for r in ocr.paired_outcomes(a, b, ["x", "y"]).orderBy("id").collect()] == ["unchanged", "improved", "regressed", "mixed"]


def test_first_kept_decides_long_chains(spark):
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(440))
    rows = [(i, line[4 * i : 4 * i + 200]) for i in range(60)]
    got = corpus.first_kept(spark.createDataFrame(rows, "ord int, text string"))
    assert sorted(r.ord for r in got.where("kept").collect()) == list(range(0, 60, 2))


def test_tree_paths_reach_every_level(spark):
    rows = [(i, i - 1 if i else None, f"t{i}") for i in range(20)]
    got = records.tree_paths(spark.createDataFrame(rows, "node int, parent int, title string")).collect()
    assert sorted((r.node, r.level, r.path) for r in got) == [(i, i, " > ".join(f"t{k}" for k in range(i + 1))) for i in range(20)]
    with pytest.raises(ValueError):
        records.tree_paths(spark.createDataFrame([*rows, (0, 19, "again")], "node int, parent int, title string"))


def test_vector_topk_in_slices(spark):
    """More queries than a slice holds, ties, copies, vectors without a cosine and fewer vectors than asked for."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(300 + i, [1.0, 0.0, 2.0, 0.0, 0.0, 1.0]) for i in range(40)]
    rows += [(400, None), (401, [0.0] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    single = {r.vec_id: r.embedding for r in vectors.collect()}

    def cosine(a, b):
        if not (a and b) or None in a or None in b or len(a) != len(b) or not any(a) or not any(b):
            return None
        return round(sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))), 6)

    for least, limit in ((0, 7), (0, 1000), (338, 2)):
        own = {i: v for i, v in single.items() if i >= least}
        frame = vectors.where(F.col("vec_id") >= least)
        queries = frame.where("vec_id % 3 = 0 or vec_id > 400").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in retrieval.vector_topk(frame, queries, 8, limit=limit).collect()}
        want = {}
        for q in (i for i in own if i % 3 == 0 or i > 400):
            scored = sorted(((-s if s is not None else 9, i, s) for i, v in own.items() for s in [cosine(v, own[q])]))
            want |= {(q, n + 1): (i, s) for n, (_, i, s) in enumerate(scored[:8])}
        assert got == want
