"""Goldens and brute force for the rules that SQL cannot express."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import identity, markdown, udfs
from corpusmill.functions import text as X
from corpusmill.operators import corpus, divisions, evaluation, fidelity, grounding, ingest, ocr, records, retrieval, service, telemetry
from corpusmill.sources import exports, jsonl


def of(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", expression(F.col("t")).alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


def test_headings(spark):
    assert of(spark, ["Chapter 3 ..... 41", "Torts & Crimes p. 7", "Notice&Claims Page 12", "Self- Help …", "UCC2-207 Approachto X", "Pleading Chapter 2: Sales", "Chapter 2 Sales Chapter 2", "", None], X.clean_heading) == ["Chapter 3", "Torts & Crimes", "Notice & Claims", "Self-Help", "UCC 2-207 Approach to X", "Pleading", "Chapter 2 Sales Chapter 2", "", ""]
    rows = spark.createDataFrame([(["Part I ", "N/A 4", "", "Torts ... 3"],), ([],), (None,)], "h array<string>")
    assert [r[0] for r in rows.select(X.section_path(F.col("h"))).collect()] == ["Part I → Torts", "", ""]
    assert of(spark, ["■ ■", " ■\n\n■\xa0■ ", "■ x", "", "□"], X.decorative_squares) == [True, True, False, False, False]
    assert of(spark, ["12 · TORTS AND CRIMES", "3 12 • TORTS, ETC.", "12 · Torts", "x"], X.division_banner) == [True, True, False, False]
    assert of(spark, ["Id. at 12-13.", "3) the end of it.", "3) the end", "A Real Heading", "WORD " * 24, "I. " + "WORD " * 24], lambda t: X.body_like_header(t, F.lit(95.0))) == [True, True, False, False, True, False]
    assert of(spark, ["WORD " * 24], lambda t: X.body_like_header(t, F.lit(None).cast("double"))) == [False]


def test_content_types_by_headings(spark):
    cases = [
        ("x. " * 30, ["Chapter 4 - Remedies", "§ 4.01 Introduction"], "chapter_introduction"),
        ("x. " * 30, ["Chapter 4 - Introduction", "Damages"], "author_narrative"),
        ("x. " * 30, ["Chapter 4 - Remedies", "§ 5.01 Introduction"], "author_narrative"),
        ("x. " * 30, ["HYPOTHETICAL on sales"], "problem_hypothetical"),
        ("Justice A wrote. It was reversed. " * 3, ["Doe v. Roe"], "case_opinion"),
        ("Justice A wrote. It was reversed. " * 3, ["A heading"], "author_narrative"),
        ("Rule 8 asks for a short statement of the claim.", ["Commentary"], "author_narrative"),
        ("Rule 8 asks for a short statement of the claim.", [], "statutory_excerpt"),
        ("1. See id. at 3, supra.\n2. Cf. that. infra" + " word" * 20, [], "footnote"),
        ("1. See that." + " word" * 20, [], "author_narrative"),
        ("CONTENTS\nx", [], "structural"),
        ("Some Advisory Board\nlower case text that goes on", [], "author_narrative"),
        ("Editorial Advisory Board\nlower case text that goes on", [], "structural"),
        ("ALL CAPS AND SHORT", [], "structural"),
        (" \n\t", [], "empty"),
        ("Questions\n1. Why is that so?", [], "notes_and_questions"),
        ("Questionable\n1. Why is that so, one may ask?", [], "author_narrative"),
    ]
    rows = spark.createDataFrame([(i, t, h) for i, (t, h, _) in enumerate(cases)], "i int, t string, h array<string>")
    got = {r.i: r.x for r in rows.select("i", X.content_type(F.col("t"), F.col("h")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [k for _, _, k in cases]


def test_case_names(spark):
    text = "See Pennoyer v. Neff, 95 U.S. 714. In re Winship held. Cf. Roe v. Wade; The Story of A v. B. Study of How Marbury v. Madison Changed Law. Pennoyer\nv. Neff"
    assert of(spark, [text, None, ""], X.case_names)[0][:3] == ["Pennoyer v. Neff", "In re Winship", "Roe v. Wade"]


def test_normalisation():
    t, changes = udfs.normalised("“ﬁrst”—second​ word.Next  line\n\n\n\n12\nclientlawyer talk\nvisit www.a.Bc")
    assert t == '"first" - second word. Next line\n\nclient-lawyer talk\nvisit www.a.Bc' and [c[0] for c in changes] == ["unicode_u201c", "unicode_u201d", "unicode_u2014", "unicode_ufb01", "safe_zero_width", "known_fused_term", "sentence_space", "horizontal_whitespace", "blank_lines", "strip_headers_footers"] or t
    assert udfs.without_zero_width("java​script:x") == "java​script:x" and udfs.without_zero_width("a​b﻿") == "ab"
    assert udfs.normalised(None) == ("", []) and udfs.normalised("clientlawyer", ("known_fused_term",))[0] == "clientlawyer"
    assert udfs.normalised("see https://perma . cc / AB12 - CD34 now")[0] == "see https://perma.cc/AB12-CD34 now"
    assert udfs.source_words("Don’t re-\nmand the co\xadurt ﬁnd") == ["don't", "remand", "the", "court", "find"]


def test_plain_tokens_need_no_python(spark):
    rng = random.Random(4)
    parts = ["the", "U.S.", "326 U. S. 310", "12(b)(6)", "$75,000.50", "re-\nmand", "it's", "F. Supp. 2d", "Straße", "fed. r. civ. p.", "s. ct.", "us", "title 42 of the united states code", "§§ 3", "f.3d", "1,000,000", "ﬁt"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(200)]
    assert of(spark, texts, udfs.analysed) == [udfs.search_tokens(t) for t in texts]


def centred(text, query, limit):
    """The excerpt by the letter of its rule."""
    if len(text) <= limit:
        return text
    low, asked = text.lower(), " ".join(query.lower().split())
    at = low.find(asked) if asked else -1
    if at < 0:
        at = min((p for w in re.findall(r"[\wÀ-￿]{4,}", asked) if (p := low.find(w)) >= 0), default=0)
    end = min(len(text), max(0, at - limit // 3) + limit)
    start = max(0, end - limit)
    if start and 0 <= (s := text.find(" ", start, min(end, start + 80))):
        start = s + 1
    if end < len(text) and (s := text.rfind(" ", max(start, end - 80), end)) > start:
        end = s
    return ("…" if start else "") + text[start:end] + ("…" if end < len(text) else "")


def test_excerpts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        text = " ".join("".join(rng.choices("abcdeé", k=rng.choice([1, 4, 9, 120]))) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["", "zzzz", text[40:52], text[200:230].replace(" ", "  "), "ab cd"])))
    df = spark.createDataFrame(rows, "i int, t string, q string").select("i", retrieval.centred_excerpt(F.col("t"), F.col("q"), 150).alias("x"))
    got = {r.i: r.x for r in df.collect()}
    assert got == {i: centred(t, q, 150) for i, t, q in rows}


def test_first_kept_decides_two_hundred_revisions(spark):
    rng = random.Random(7)
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1100))
    df = spark.createDataFrame([(i, line[4 * i : 4 * i + 200]) for i in range(200)], "ord int, text string")
    assert sorted(r.ord for r in corpus.first_kept(df).where("kept").collect()) == list(range(0, 200, 2))
    old = corpus.OPEN_AT_ONCE
    try:  # by rounds
        corpus.OPEN_AT_ONCE = 4
        assert sorted(r.ord for r in corpus.first_kept(df.where("ord < 16")).where("kept").collect()) == list(range(0, 16, 2))
    finally:
        corpus.OPEN_AT_ONCE = old
    two = spark.createDataFrame([(0, "abcdefgh" * 9, "a"), (1, "abcdefgh" * 9, "b"), (2, "abcdefgh" * 9, "a")], "ord int, text string, scope string")
    assert [r.kept for r in corpus.first_kept(two, apart=["scope"]).orderBy("ord").collect()] == [True, True, False]


def _alike_texts(n):
    """Texts of one vocabulary, most of which share most of their trigrams; lengths differ too."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(120)]
    return [" ".join(w for w in words if rng.random() > share) + " " + words[0] * rng.choice([1, 1, 60]) for share in (rng.choice([0.01, 0.05, 0.1]) for _ in range(n))]


def _alike(texts, threshold):
    """{(i, j): similarity} of the linked texts, by brute force."""
    prints = [t.replace(" ", "") for t in texts]
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in prints]
    pairs = ((i, j) for j in range(len(texts)) for i in range(j) if prints[i] != prints[j] and abs(len(prints[i]) - len(prints[j])) <= 0.2 * max(len(prints[i]), len(prints[j])))
    return {(i, j): v for i, j in pairs if (v := len(grams[i] & grams[j]) / len(grams[i] | grams[j])) >= threshold}


def test_similar_pairs_compares_few_whole_sets(spark, monkeypatch):
    """Alike texts that are not linked meet at many signatures, but hardly any reach the comparison of whole sets, and a pair does so once."""
    texts = list(dict.fromkeys(_alike_texts(160)))
    df = spark.createDataFrame(list(enumerate(texts)), "ord int, text string")
    want = _alike(texts, 0.95)
    asked, whole = [], corpus._linked
    monkeypatch.setattr(corpus, "_linked", lambda pairs, *a: asked.append(pairs) or whole(pairs, *a))
    for crowd in (corpus.CROWD, 3):  # in one block and in many
        monkeypatch.setattr(corpus, "CROWD", crowd)
        got = {(r.ord_a, r.ord_b): r.jaccard for r in corpus.similar_pairs(df).collect()}
        assert got == want and len(want) > 100
        pairs = [(r.a, r.b) for r in asked.pop().collect()]
        assert len(set(pairs)) == len(pairs) < 1.5 * len(want)
    sets = corpus.marks(corpus.signed_sets(df), 0.95)
    met = sets.alias("x").join(sets.alias("y"), "sig").where("x.ord < y.ord").select("x.ord", "y.ord").distinct().count()
    assert met > 4 * len(want)
    loose = _alike(texts, 0.7)
    assert {(r.ord_a, r.ord_b): r.jaccard for r in corpus.similar_pairs(df, 0.7).collect()} == loose and len(loose) > len(want)


def test_marks_are_few_and_meet_across_classes(spark):
    """Sets of all sizes about the bounds of their classes are linked, with few more marks than sets of one size need."""
    line = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=300))
    texts = [line[:n] for n in range(90, 300, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "ord int, text string")
    for threshold in (0.95, 0.8):
        got = {(r.ord_a, r.ord_b): r.jaccard for r in corpus.similar_pairs(df, threshold).collect()}
        assert got == _alike(texts, threshold) and len(got) > 200
    needed = sum(int(0.05 / 1.95 * 2 * len({t[i : i + 3] for i in range(len(t) - 2)})) + 1 for t in texts)
    assert corpus.marks(corpus.signed_sets(df), 0.95).count() < 1.7 * needed


def test_first_kept_lists_few_links(spark, monkeypatch):
    """A group of near copies of its first one is gone after a round; what is left is decided in order, by rounds or not."""
    texts = [t + "q" * (i % 3) for i, t in enumerate(_alike_texts(60))]
    line = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=400))
    texts += [line, *(line[:i] + "#" + line[i + 1 :] for i in range(0, 400, 5))]
    prints = [t.replace(" ", "").replace("#", "") for t in texts]
    links = _alike(prints, 0.95)
    kept = []
    for j, t in enumerate(prints):
        if t not in prints[:j] and not any((i, j) in links for i in kept):
            kept.append(j)
    df = spark.createDataFrame(list(enumerate(texts)), "ord int, text string")
    listed, left_out = [], corpus._left_out
    monkeypatch.setattr(corpus, "_left_out", lambda links: listed.append(links.count()) or left_out(links))
    for open_, at_once in ((20_000, 2_000_000), (2, 2_000_000), (2, 2)):
        monkeypatch.setattr(corpus, "OPEN_AT_ONCE", open_)
        monkeypatch.setattr(corpus, "LINKS_AT_ONCE", at_once)
        assert sorted(r.ord for r in corpus.first_kept(df).where("kept").collect()) == kept
    between = [p for p in links if all(prints[i] not in prints[:i] for i in p)]  # equal ones meet others in their first one
    assert listed[0] == len(between) and max(listed[1:]) < len(between) / 4


def test_numbering_over_tasks(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", None]), i, rng.randint(0, 9), rng.choice([None, 1, 2, 3])) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, v int, x int")
    got = {r.o: (r.number, r.total, r.last) for r in corpus.numbered(df, "g", ["o"], {"total": F.col("v")}, {"last": F.col("x")}).collect()}
    for g in ("a", None):
        own, total, last = sorted(r for r in rows if r[0] == g and True) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]), 0, None
        own = sorted(own, key=lambda r: r[1])
        for i, (_, o, v, x) in enumerate(own):
            total += v
            assert got[o] == (i, total, last)
            last = x if x is not None else last


def test_granted_pages(spark):
    rng = random.Random(2)
    books = {b: [rng.choice([None, *range(1, 12)]) for _ in range(rng.randint(1, 12))] for b in range(40)}
    df = spark.createDataFrame([(b, i, p) for b, ps in books.items() for i, p in enumerate(ps)], "book int, ord int, page int")
    got = {(r.book, r.ord): (r.start_page, r.end_page, r.granted) for r in corpus.page_ranges(df, 15).collect()}
    for b, ps in books.items():
        filled, last = [], None
        for p in ps:
            last = p or last
            filled.append(last)
        held = set()
        for i, p in enumerate(filled):
            end = None if p is None else next((q - 1 for q in filled[i + 1 :] if q and q > p), 15)
            ok = p is not None and p not in held
            held |= set(range(p, end + 1)) if ok else set()
            assert got[b, i] == (p, end, ok)


def test_context_and_sources(spark):
    texts = {"a": "first", "b": "second", "c": "third " * 400, "d": "first", "e": "fifth", "f": ""}
    ids = list(texts)
    rows = [(s, ids[i - 1] if i else "", ids[i + 1] if i + 1 < len(ids) else "", texts[s], json.dumps({"n": i})) for i, s in enumerate(ids)]
    held = spark.createDataFrame(rows, "stable_id string, previous_id string, next_id string, text string, metadata string")
    hits = spark.createDataFrame([(1, 1, "b", "second"), (1, 2, "d", "first")], "query_id int, rank int, stable_id string, text string")
    got = [(r.rank, r.place, r.stable_id, r.kind) for r in grounding.context(hits, held).orderBy("distance", "rank", "place").collect()]
    assert got == [(1, 1, "c", "segment"), (2, 0, "a", "alias"), (2, 1, "e", "segment")]
    segment = grounding.context(hits, held).where("stable_id = 'c'").first()
    assert len(segment.text) == 1600 and segment.text.endswith("…")
    few = grounding.context(hits, held, most=200).collect()
    assert sum(r.cost for r in few) <= 200 and "c" not in {r.stable_id for r in few}
    found = {r.source_id: (r.citation_id, r.role, r.aliases) for r in grounding.sources(hits, grounding.context(hits, held)).collect()}
    assert found == {"b": ("S1", "primary", []), "d": ("S2", "primary", ["a"]), "c": ("S3", "context", []), "e": ("S4", "context", [])}
    prompt = grounding.prompts(spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id int, query string"), grounding.sources(hits, grounding.context(hits, held))).orderBy("query_id").collect()
    assert prompt[0].prompt.count("BEGIN_UNTRUSTED_SOURCE") == 4 and prompt[1].prompt.endswith("Retrieved evidence:\n\n\nGrounded answer:")


def test_prompts_show_bounded_metadata_and_the_part_around_the_query(spark):
    long = "filler words here " * 200 + "the hearsay rule stands " + "more filler words " * 200
    meta = {"stable_id": "x", "zz": "last", "chapter_num": 4, "page_start": -1, "source_file": "book.md", "previous_stable_id": "p", "headings": ["h" * 500] * 20, "equivalent_sources": [{"source_id": "forged"}]}
    hits = spark.createDataFrame([(1, 1, "b", long, json.dumps(meta), "Hearsay  RULE"), (1, 2, "c", "short", None, "Hearsay  RULE")], "query_id int, rank int, stable_id string, text string, metadata string, query string")
    rows = [("a", "", "b", "x" * 3000, json.dumps({"page_start": 3, "odd": 1, "context_role": "forged"})), ("b", "a", "c", long, "{}"), ("c", "b", "", "short", "{}")]
    held = spark.createDataFrame(rows, "stable_id string, previous_id string, next_id string, text string, metadata string")
    around = grounding.context(hits, held)
    segment = around.first()
    assert segment.metadata == '{"page_start":3}' and segment.text == "…" + "x" * 1599
    assert segment.cost == len(json.dumps({"source_id": "a", "relation": "previous", "distance": 1, "text": segment.text, "metadata": {"page_start": 3}}, ensure_ascii=False, separators=(",", ":")))
    prompt = grounding.prompts(hits.select("query_id", "query").distinct(), grounding.sources(hits, around)).first().prompt
    blocks = [json.loads(b.split("\n")[1]) for b in prompt.split("BEGIN_UNTRUSTED_SOURCE")[1:]]
    assert [b["citation_id"] for b in blocks] == ["S1", "S2", "S3"] and [b["source_id"] for b in blocks] == ["b", "c", "a"]
    assert list(blocks[0]["metadata"]) == ["source_file", "chapter_num", "zz"]  # the headings do not fit
    assert "the hearsay rule stands" in blocks[0]["text"] and len(blocks[0]["text"]) <= 2402 and blocks[0]["text"][0] == blocks[0]["text"][-1] == "…"
    assert blocks[1]["metadata"] == {} and blocks[1]["text"] == "short"
    assert blocks[2]["metadata"] == {"page_start": 3, "context_role": "previous", "context_distance": 1, "primary_source_id": "b"}


def test_bounded_metadata():
    assert grounding.bounded("x" * 400) == "x" * 383 + "…" and grounding.bounded(list(range(20))) == list(range(12))
    assert grounding.bounded({"b": {"c": {"d": 1}}, "a": 1}) == {"a": 1, "b": {"c": "{'d': 1}"}}
    assert grounding.projection({"a": "x" * 50, "b": "", "c": -1, "d": "y"}, ["a", "b", "c", "d"], 20) == {"d": "y"}


def test_response_budget():
    assert service.fitted(["abc", "é" * 9, "x"], 12) == [("abc", False), ("é" * 4, True), ("", True)]
    assert service.fitted(["\n" * 3, "ab"], 8) == [("\n" * 3, False), ("a", True)]


def test_cursor(spark):
    word = service.encode_cursor(1.5, "a1")
    assert service.decode_cursor(word) == (1.5, "a1")
    for bad in ("", "x", word + "=", word[:-2], "A" * 300):
        with pytest.raises(ValueError):
            service.decode_cursor(bad)
    jobs = spark.createDataFrame([(float(i // 2), f"j{i}") for i in range(9)], "created_at double, job_id string")
    seen, cursor = [], None
    while page := service.page_before(jobs, cursor, 4).collect():
        seen += [r.job_id for r in page]
        cursor = page[-1].cursor
    assert seen == ["j8", "j7", "j6", "j5", "j4", "j3", "j2", "j1", "j0"]


def test_divisions():
    own = divisions.CHAPTERS
    found = divisions.divisions("Chapter 3: Pleading\nbody\nChapter Twenty-One - Remedies\nChapter 99 x", own, "chunk_heading")
    assert [(d["ordinal"], d["kind"], d["title"]) for d in found] == [(3, "Chapter", "Pleading"), (21, "Chapter", "Remedies")]
    assert divisions.canonical_title(found[0], own) == "Chapter 3: Pleading" and divisions.fallback_title(divisions.PARTS, 4) == "Part IV"
    assert divisions.holds_subnumber("see 3-1", found[0]) and not divisions.holds_subnumber("see 13-1", found[0])
    assert divisions.section("Table of Contents", own).excluded and divisions.section("Torts", own) is None
    assert divisions.profile_of(own.receipt()) is own
    with pytest.raises(ValueError):
        divisions.profile_of(own.receipt() | {"sha256": "0" * 64})
    with pytest.raises(ValueError):
        divisions.profile("none")


def test_alignment():
    source = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("b", 1, "z")]
    assert fidelity.aligned(["x", "z"], source, set()) == [("b", 0), ("b", 1)]
    assert fidelity.aligned(["x"], source, {("a", 0)}) == [("b", 0)]
    assert fidelity.aligned(["y", "z"], source, set()) == [("a", 1), ("b", 1)]
    assert fidelity.aligned(["z", "y"], source, set()) is None and fidelity.aligned([], source, set()) == []
    assert fidelity.aligned(["x", "y"], source, {("a", 0)}) is None


def test_fidelity_audit(spark):
    items = spark.createDataFrame([("d", 0, "#0", "one two"), ("d", 1, "#1", "three")], "doc string, place int, ref string, text string")
    rows = spark.createDataFrame([("d", 0, "One two", ["#0"]), ("d", 1, "three four", ["#1"]), ("d", 2, "x", []), ("d", 3, "", None)], "doc string, ord int, text string, refs array<string>")
    got = {(r.kind, r.key): (r.covered, r.issue) for r in fidelity.audit(rows, items).collect()}
    assert got == {("record", "0"): (2, None), ("record", "1"): (0, "unattested_words"), ("record", "2"): (0, "no_source"), ("record", "3"): (0, None), ("item", "#0"): (2, None), ("item", "#1"): (0, "words_lost")}


def test_markdown():
    assert markdown.plain_project("﻿a\r\n<!-- CASE: Roe v. Wade -->\n[b](ch02.md#x) [c](https://x.org)\n\n\n\nd", {"ch02.md"}) == ("a\n_Case opinion: Roe v. Wade._\nb [c](https://x.org)\n\nd\n", None)
    assert markdown.plain_project("<!-- x -->", set())[1] == "hidden_comment" and markdown.plain_project("[a](b.md)", set())[1] == "local_link"
    assert [markdown.footnote_issue(t) for t in ("a[^1]\n[^1]: x", "a[^x]", "a[^1] b[^1]\n[^1]: x", "a[^1]", "a[^2]\n[^2]: x")] == [None, "footnote_label", "footnote_repeated", "footnote_unpaired", "footnote_order"]
    assert markdown.issues("| a | b |\n|---|---|\n| 1 |\n\n```\n| x |") == ["open_fence", "table_width"] and markdown.issues("| a |\n| b |") == ["table_without_rule"] and markdown.issues(None) == []


def test_geometry(spark):
    import numpy as np

    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert ocr.clipped_polygon(square, 1, 1, 9, 3) == [(4.0, 1.0), (4.0, 3.0), (1.0, 3.0), (1.0, 1.0)] or sorted(ocr.clipped_polygon(square, 1, 1, 9, 3)) == [(1.0, 1.0), (1.0, 3.0), (4.0, 1.0), (4.0, 3.0)]
    assert ocr.clipped_polygon(square, 9, 9, 10, 10) == []
    rng = random.Random(3)
    for _ in range(500):
        a, b = rng.randint(-10**6, 10**6), rng.choice([1, 3, 7, 1000, 2**20, 10**9])
        assert ocr.nearest_binary32(a, b) == float(np.float32(a / b)) or abs(a / b - ocr.nearest_binary32(a, b)) <= abs(a / b - float(np.float32(a / b)))
    quad = spark.createDataFrame([([(0.0, 0.0), (10.0, 0.5), (10.0, 5.0), (0.2, 5.0)],), ([(0.0, 0.0), (10.0, 4.0), (10.0, 9.0), (0.0, 5.0)],)], "q array<struct<x:double,y:double>>")
    assert [r[0] and tuple(r[0]) for r in quad.select(ocr.rectangle(F.col("q"))).collect()] == [(0.0, 0.0, 10.0, 5.0), None]


def test_identity_of_context():
    meta = {"source_file": "f", "chapter_num": 3}
    assert identity.context_parent(meta) == identity.context_parent(meta | {"page_start": 9}) != identity.context_parent(meta | {"chapter_num": None})
    assert [identity.context_parent(meta | x) for x in ({"content_type": "structural"}, {"retrieval_role": "table_child"}, {"content_source": "figure"}, {"chapter_num": "3"}, {"source_file": " "})] == [""] * 5


def test_planner(spark):
    assert retrieval.fetch_size(5, "hybrid") == 20 and retrieval.fetch_size(5, "vector") == 5 and retrieval.fetch_size(5, "vector", manifest_children=2) == 20
    assert retrieval.planned_mode("auto") == ("vector", []) and retrieval.planned_mode("auto", "x", "x") == ("hybrid", [])
    with pytest.raises(ValueError):
        retrieval.planned_mode("hybrid", "x", "y")
    dense = spark.createDataFrame([(1, 1, 7, 0.5)], "query_id int, rank int, doc_id int, score double")
    assert retrieval.hybrid(dense, None)[1] == ["bm25 search failed"]
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)] + [(9, None)], "id int, embedding array<double>")
    assert {r.cluster for r in retrieval.summary_clusters(same, 3).collect()} == {0} and retrieval.summary_clusters(same.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="dimension"):
        retrieval.dimension_checked(same.where("embedding is not null"), 3).collect()


def test_limits_and_joined_leads(spark):
    assert evaluation.metric_limits(["mrr=0.5", "ndcg@10 = 1"]) == {"mrr": 0.5, "ndcg@10": 1.0}
    for bad in ("mrr", "=1", "mrr=x", "mrr=-1", "mrr=inf"):
        with pytest.raises(ValueError):
            evaluation.metric_limits([bad])
    rows = spark.createDataFrame([("g", 0, "a lead"), ("g", 1, "goes on."), ("g", 2, "next"), ("g", 3, "one two three four"), ("g", 4, None)], "g string, o int, text string")
    assert [(r["first"], r.n_records, r.text) for r in ingest.joined_leads(rows, "g", "o", 4).orderBy("first").collect()] == [(0, 2, "a lead goes on."), (2, 1, "next"), (3, 2, "one two three four ")]


def test_more_sources(spark, tmp_path):
    good = {"text": "a b", "metadata": {"content_type": "x"}}
    path = tmp_path / "chunks.jsonl"
    path.write_text(json.dumps(good) + '\n\n{"text": "x y", "metadata": {}}\nnope\n', encoding="utf-8")
    assert [(r.ord, r.error) for r in jsonl.lenient_chunks(spark, str(path)).orderBy("ord").collect()] == [(1, None), (3, "missing_content_type"), (4, "syntax")]
    (tmp_path / "empty.jsonl").write_text("\n \n")
    with pytest.raises(ValueError):
        jsonl.lenient_chunks(spark, str(tmp_path / "empty.jsonl"))
    queries = tmp_path / "q.jsonl"
    queries.write_text('{"query_id": "1", "query": "why", "judgments": [{"chunk_id": "c", "relevance": 2, "accepted_children": ["k"]}]}\n{"query": ""}\n{"query": "x", "judgments": [{"relevance": 1}]}\n')
    rows = jsonl.judged_queries(spark, str(queries)).orderBy("ord")
    assert [r.error for r in rows.collect()] == [None, "missing_query", "bad_judgment"]
    judged = evaluation.normalised_judgments(rows.where("error is null").select("query_id", "judgments")).collect()
    assert {(r.satisfying_id, r.match_kind) for r in judged} == {("c", "exact"), ("k", "accepted_table_child")}
    (tmp_path / "usage.json").write_text(json.dumps({"counts": {"exact_prompt_tokens": 3, "exact_completion_tokens": 1, "estimated_prompt_tokens": 2, "estimated_completion_tokens": 0, "exact_usage_attempts": 1, "estimated_usage_attempts": 0, "unknown_usage_attempts": 0}}))
    report = jsonl.usage_report(spark, str(tmp_path / "usage.json")).first()
    assert (report.input_tokens, report.output_tokens, report.error) == (5, 1, "tokens_without_attempts")
    assert jsonl.file_snapshots(spark, str(path)).first().bytes == path.stat().st_size
    with pytest.raises(ValueError):
        jsonl.file_snapshots(spark, str(path), 3)
    exports.append_jsonl(spark.range(2), str(tmp_path / "log"))
    exports.append_jsonl(spark.range(2), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert exports.storage(spark, str(tmp_path / "log")).first().file_count >= 2
    exports.write_report({"mode": "x"}, spark.createDataFrame([("mrr", 0.5)], "metric string, value double"), str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first()[0]) == {"mode": "x", "metrics": [{"metric": "mrr", "value": 0.5}]}


def test_index_ids_and_one_line_json(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "index"))
    assert sorted(r.id for r in jsonl.index_ids(spark, str(tmp_path / "index")).collect()) == list(range(7))
    row = spark.createDataFrame([("a\u2028b\x85c",)], "t string").select(X.one_line_json(F.struct("t")).alias("j")).first().j
    assert len(row.splitlines()) == 1 and json.loads(row) == {"t": "a\u2028b\x85c"}


def test_lines_over_many_splits(spark, tmp_path):
    rng = random.Random(6)
    own = ["é" * rng.randint(0, 300) + " " for _ in range(3000)]
    (tmp_path / "big.txt").write_text("\n".join(own), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        got = [r.line for r in jsonl.lines(spark, str(tmp_path / "big.txt")).orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == own


def test_projects(spark):
    rows = [("p", "ch02.md", "two[^1]\n\n[^1]: n"), ("p", "front_matter.md", "front"), ("p", "ch01_a.md", "one[^1]\n\n[^1]: m"), ("p", "back_matter.md", "b" * 500)]
    files = spark.createDataFrame(rows, "project string, name string, text string")
    got = exports.project_groups(files, 2).orderBy("part").collect()
    assert [r.names for r in got] == [["front_matter.md", "ch01_a.md", "ch02.md"], ["back_matter.md"]]
    assert got[0].text == "front\n\n---\n\none[^1]\n\n[^1]: m\n\n---\n\ntwo[^2]\n\n[^2]: n\n"
    with pytest.raises(Exception, match="not a file of a book"):
        exports.project_groups(spark.createDataFrame([("p", "x.md", "t")], files.schema), 2).collect()


def test_edit_distances_count_code_points(spark):
    from corpusmill.plans.catalog import QUERIES

    rows = {r.item_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, old = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(old[j - 1] + (x != y), old[j] + 1, d[-1] + 1))
        return d[-1]

    for r in QUERIES["edit_distance_rates"](spark, "/root/testdata/sf0.001").limit(12).collect():
        assert (r.distance, r.units) == (distance(rows[r.item_id], rows[r.item_id + 1]), len(rows[r.item_id]))


def test_samples_and_bootstrap(spark):
    rows = spark.createDataFrame([(g, i) for g in "ab" for i in range(30)], "g string, id long")
    got = corpus.spot_audit(rows, "g", "id", 6, "s")
    want = {g: corpus.spot_sample(list(range(30)), 6, f"s:{g}") for g in "ab"}
    assert {g: [r.id for r in got.where(F.col("g") == g).orderBy("place").collect()] for g in "ab"} == want
    assert {r.chance for r in got.collect()} == {0.2}
    pairs = spark.createDataFrame([("m", i, 0.0, 1.0 if i % 2 else 0.5) for i in range(8)], "metric string, query_id int, baseline double, candidate double")
    r = evaluation.paired_bootstrap(pairs).first()
    assert r.n_pairs == 8 and r.mean_delta == 0.75 and 0.5 <= r.ci_low <= 0.75 <= r.ci_high <= 1 and r.p_value <= 2 / 2001 + 1e-9


def test_budget_allocation(spark):
    items = spark.createDataFrame([("g", i, c) for i, c in enumerate([5, 9, 3, 4, 1])], "g string, o int, c long")
    assert [r.taken for r in corpus.allocate(items, "g", "o", "c", 10).orderBy("o").collect()] == [True, False, True, False, True]


def test_table_limits(spark):
    many = spark.createDataFrame([("k", "p", "| a |\n|---|\n" + "\n".join("| 1 |" for _ in range(129)), False)], "source_key string, stable_id string, text string, is_child boolean")
    with pytest.raises(Exception, match="too many"):
        records.table_children(many).collect()
    assert records.table_children(many, of_parent=None).count() == 129
    with pytest.raises(Exception, match="too many children in all"):
        records.table_children(many, of_parent=None, of_all=128).collect()


def test_log_rules(spark):
    log = spark.createDataFrame([("a", 1, "run", "started", None), ("a", 2, "s", "started", None), ("b", 1, "s", "started", None), ("c", 1, "run", "started", "p"), ("c", 2, "run", "succeeded", "p"), ("c", 4, "s", "odd", "q")], "run_id string, sequence long, stage string, status string, parent_run_id string")
    assert sorted((r.run_id, r.issue) for r in telemetry.log_issues(log).collect()) == [("b", "no_run_start"), ("c", "events_after_end"), ("c", "sequence_gap")]
    closed = [(r.run_id, r.sequence, r.stage, r.source_event_count, r.active_stages_closed) for r in telemetry.recovery(log).orderBy("run_id", "sequence").collect()]
    assert closed == [("a", 3, "s", None, None), ("a", 4, "run", 2, 1), ("b", 2, "s", None, None), ("b", 3, "run", 1, 1)]


def test_texts_are_taken_in_portions(spark):
    """Slices hold few bytes and all rows; rows of texts come out as the functions give them."""
    import pyarrow as pa

    from corpusmill.functions import udfs

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 900, None, "b" * 3000, "", "c" * 900, "d" * 10])], names=["doc_id", "text"])
    parts = list(udfs.portions(batch, 1, 1000))
    assert sum(p.num_rows for p in parts) == 6 and len(parts) >= 4
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    texts = [(0, "Plain  text.It goes on"), (1, None), (2, "")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for f, shape in ((udfs.change_rows, udfs.CHANGED), (udfs.attestation_rows, udfs.ATTESTATION)):
        want = [(i, *row) for i, t in texts for row in f(t)]
        assert sorted((tuple(r) for r in udfs.told_of(frame, f, shape).collect()), key=str) == sorted(want, key=str)
