"""The alignment of records with their source against a scan of every place."""

import hashlib
import json
import random
import time

from pyspark.sql import functions as F

from corpusmill.functions.udfs import source_words
from corpusmill.operators import corpus, fidelity


def scanned(words, source, covered, outside):
    """Places of ``source`` (words) by the rule as it is written, one start after another."""
    if not words:
        return []
    n, together = len(words), []
    for i in range(len(source) - n + 1):
        if source[i : i + n] == words:
            together.append((-sum(k not in covered for k in range(i, i + n)), i))
    if together:
        fresh, at = min(together)
        return list(range(at, at + n)) if -fresh == n else None
    out, at = [], 0
    for w in words:
        while at < len(source) and (source[at] != w or at in covered or at in outside):
            at += 1
        if at == len(source):
            return None
        out.append(at)
        at += 1
    return out


def test_alignment_is_that_of_a_scan():
    rng = random.Random(11)
    for _ in range(3000):
        source = rng.choices("abc", k=rng.randint(0, 14))
        cut = rng.randint(0, len(source))
        held = fidelity.Words([("x", source[:cut], False), ("y", source[cut:], rng.random() < 0.3)])
        covered = {i for i in range(len(source)) if rng.random() < 0.25}
        for i in covered:
            held.covered[i] = True
        outside = {i for i in range(len(source)) if held.outside[i]}
        at = rng.randint(0, len(source))
        words = source[at : at + rng.randint(0, 5)] if rng.random() < 0.6 else rng.choices("abcd", k=rng.randint(0, 4))
        found = held.aligned(words, ["x", "y"])
        assert (None if found is None else found.tolist()) == scanned(words, source, covered, outside)


def test_alignment_is_linear_in_what_is_cited():
    began = time.time()
    for source in (["a"] * 200_000, [str(i % 1000) for i in range(200_000)]):
        held = fidelity.Words([("x", source, False)])
        assert held.aligned(source[:-1] + ["zz"], ["x"]) is None
        assert len(held.aligned(source[: 100_000], ["x"])) == 100_000
        assert len(held.aligned(source[::2], ["x"])) == 100_000
    assert time.time() - began < 20


def test_containers_and_items_out_of_scope(spark):
    items = [("d", 0, "a", "one two", "box", None), ("d", 1, "b", "three four", "inner", None), ("d", 2, "inner", None, "box", None), ("d", 3, "view", "five six", None, True), ("d", 4, "c", "seven", None, False)]
    held = spark.createDataFrame(items, "doc string, place int, ref string, text string, container string, out_of_scope boolean")
    rows = [("d", 0, "one two three", ["box"]), ("d", 1, "four", ["inner"]), ("d", 2, "five six", ["view"]), ("d", 3, "six seven", ["view", "c"]), ("d", 4, "lost", ["gone"]), ("d", 5, "seven", ["view", "c", "gone"]), ("d", 6, None, None)]
    records = spark.createDataFrame(rows, "doc string, ord int, text string, refs array<string>")
    found = {(r.kind, r.key): (r.n_words, r.covered, r.issue) for r in fidelity.audit(records, held).collect()}
    assert found["record", "0"] == (3, 3, None) and found["record", "1"] == (1, 1, None) and found["record", "2"] == (2, 2, None)
    assert found["record", "3"] == (2, 0, "unattested_words")  # a window with a taken word does not count, nor does a part of a view
    assert found["record", "4"] == (1, 0, "no_source") and found["record", "5"] == (1, 1, None) and found["record", "6"] == (0, 0, None)
    assert {k: v for (kind, k), v in found.items() if kind == "item"} == {"a": (2, 2, None), "b": (2, 2, None), "inner": (0, 0, None), "view": (2, 2, None), "c": (1, 1, None)}


def test_attestation_roots_are_those_of_one_json_list(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        items = rng.choice([None, [], [("#/a", None)], [("#/a", fidelity.OPAQUE[0]), ("#/b", None), (None, None)]])
        rows.append((rng.choice(["x", "x", "y", None]), i, rng.choice([None, "", "Two wörds", 'quote " and \\ \n line']), items, rng.choice([None, "table_parent", "table_child"])))
    records = spark.createDataFrame(rows, "g string, o int, text string, items array<struct<ref:string,transform:string>>, retrieval_role string")
    want = {}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for g in ("x", "y", None):
        found = []
        for place, (_, _, text, items, role) in enumerate(r for r in rows if r[0] == g):
            words = source_words(text)
            lexical = sha("\0".join(words))
            opaque = any(t in fidelity.OPAQUE for _, t in items or [])
            own = {"schema_version": fidelity.ATTESTATION_VERSION, "output_text_sha256": sha(text or ""), "output_lexical_sha256": lexical, "output_lexical_count": len(words), "opaque_output_sha256": lexical if opaque else None, "opaque_source_refs": [r for r, _ in items or [] if r] if opaque else []}
            if role != "table_child":
                found.append({"record_index": place, "attestation": own})
        want[g] = (sha(json.dumps(found, ensure_ascii=False, sort_keys=True, separators=(",", ":"))), len(found))
    assert {r.g: (r.root, r.n) for r in fidelity.attestation_roots(records, "g", "o").collect()} == want


def test_ordered_digests_in_small_pieces(spark):
    rows = [("abc"[i % 2] if i % 7 else None, i, None if i % 11 == 0 else f"té{i}") for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, o int, t string")
    for piece in (1, 50, 1 << 20):
        found = {r.g: (r.root, r.n) for r in corpus.ordered_digests(frame, "g", ["o"], F.col("t"), ", ", "<", ">", piece).collect()}
        own = {g: [t or "" for k, _, t in rows if k == g] for g in ("a", "b", None)}
        assert found == {g: (hashlib.sha256(f"<{', '.join(t)}>".encode()).hexdigest(), len(t)) for g, t in own.items()}
    assert corpus.ordered_digests(frame.limit(0), "g", ["o"], F.col("t")).count() == 0
