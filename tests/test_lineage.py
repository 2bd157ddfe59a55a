"""Document order, wrapped pages, heading scopes of any depth and bound records, against plain Python."""

import itertools
import random

import pytest

from corpusmill.operators import ingest, lineage, records

ITEMS = "doc string, ord long, level int, attested boolean, content boolean, resets boolean, title string"


def brute_paths(rows, nested):
    out = {}
    for doc, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])), key=lambda r: r[0]):
        stack, content = [], True
        for _, at, level, attested, has_content, resets, _ in own:
            before = None
            if resets:
                stack, content = [], True
            elif level is not None:
                before = [a for _, a in stack]
                if nested and not content and stack and not attested:
                    level = max(level, stack[-1][0] + 1)
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, at))
                content = False
            elif has_content:
                content = True
            out[doc, at] = ([a for _, a in stack], before)
    return out


@pytest.mark.parametrize("nested", [True, False])
@pytest.mark.parametrize("n, dense", [(400, 0.5), (300, 0.95), (300, 0.2), (50, 1), (0, 1)])
def test_scopes_go_on_over_ranges(spark, n, dense, nested):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        level = rng.choice([1, 2, 3, 5, 9, 12]) if rng.random() < dense else None
        rows.append((rng.choice(["a", "a", "b", None]), i, level, rng.choice([None, True, False, False]), rng.choice([True, False, None]), rng.random() < 0.01, "t"))
    found = lineage.heading_paths(spark.createDataFrame(rows, ITEMS), "doc", "ord", nested)
    assert {(r.doc, r.ord): (r.path, r.before) for r in found.collect()} == brute_paths(rows, nested)


def test_stretches_are_a_monoid():
    """However a document is cut, the states behind the cuts are those of one walk."""
    rng = random.Random(7)
    for _ in range(300):
        rows = [dict(level=rng.choice([None, 1, 2, 4, 9]), attested=rng.random() < 0.2, content=rng.random() < 0.5, resets=rng.random() < 0.04, at=i) for i in range(rng.randrange(12))]
        nested = rng.random() < 0.7
        plain, state, at = lineage.Scopes(), lineage.Scopes(), 0
        for row in rows:
            if row["resets"]:
                plain = lineage.Scopes()
            elif row["level"] is not None:
                plain.heading(row["level"], row["attested"], row["at"], nested)
            elif row["content"]:
                plain.content = True
        while at < len(rows):
            to, own = at + rng.randrange(1, 6), lineage.Stretch()
            for row in rows[at:to]:
                own.add(row, nested)
            state, at = lineage.after_stretch(state, own, nested), to
        assert state == plain


def test_headings_of_the_ninth_level_count(spark):
    rows = [("d", i, i + 1 if i < 9 else None, None, True, False, f"h{i}") for i in range(10)]
    found = ingest.heading_scopes(spark.createDataFrame(rows, ITEMS), "doc", "ord").where("ord = 9").first()
    assert found.path == " > ".join(f"h{i}" for i in range(9))


TREE = "node long, parent long, title string"


def test_trees_of_any_depth(spark):
    chain = [(i, i - 1 if i else None, f"t{i}") for i in range(40)] + [(100, 5, "side"), (101, None, "alone")]
    found = {r.node: (r.level, r.path) for r in records.tree_paths(spark.createDataFrame(chain, TREE)).collect()}
    assert found[39] == (39, " > ".join(f"t{i}" for i in range(40)))
    assert found[100] == (6, "t0 > t1 > t2 > t3 > t4 > t5 > side") and found[101] == (0, "alone") and len(found) == 42
    assert records.tree_paths(spark.createDataFrame([], TREE)).count() == 0


@pytest.mark.parametrize("bad", [[(7, 8), (8, 7)], [(9, 77)], [(7, 8), (8, 9), (9, 8), (10, 7)], [(7, 7)], [(1, None)]], ids=str)
def test_rows_without_one_path_are_an_error(spark, bad):
    rows = [(1, None, "a"), (2, 1, "b")] + [(n, p, "x") for n, p in bad]
    with pytest.raises(ValueError):
        records.tree_paths(spark.createDataFrame(rows, TREE)).collect()


def test_items_out_of_the_tree_come_last(spark):
    nodes = [("d", "a", None, 0, True), ("d", "g", None, 1, False), ("d", "b", "g", 1, True), ("d", "c", "g", 0, True), ("d", "e", "c", 0, True)]
    nodes += [("d", "z", "gone", 5, True), ("d", "y", "q", 3, True), ("d", "q", "y", 4, True), ("e", "a", None, 2, True), ("f", "loose", "x", 0, True)]
    found = lineage.document_order(spark.createDataFrame(nodes, "doc string, ref string, parent string, place int, item boolean")).collect()
    assert sorted((r.doc, r.ord, r.ref) for r in found) == [*[("d", i, x) for i, x in enumerate("acebyqz")], ("e", 0, "a"), ("f", 0, "loose")]


BOX = "doc string, ref string, place int, page int, top double, bottom double, left double, right double, label string, words int, marker string, page_height double, page_width double, structural boolean"


def repaired(spark, tops, **over):
    rows = []
    for i, top in enumerate(tops):
        own = dict(doc="d", ref=f"r{i}", place=10 + i, page=1, top=float(top), bottom=top + 20.0, left=50.0, right=150.0, label="text", words=99, marker=None, page_height=700.0, page_width=500.0, structural=False)
        own |= over.get(f"r{i}", {}) | over.get("all", {})
        rows.append(tuple(own.values()))
    found = lineage.repaired_places(spark.createDataFrame(rows, BOX)).collect()
    assert sorted(r.place for r in found) == [10 + i for i in range(len(tops))]
    return "".join(r.ref[1:] for r in sorted(found, key=lambda r: r.place))


def test_wrapped_pages(spark):
    assert repaired(spark, [400, 500, 100, 200]) == "2301"  # what comes late stands above the rest
    assert repaired(spark, [400, 500, 100]) == "012"  # too few nodes
    assert repaired(spark, [400, 500, 300, 350]) == "0123"  # no jump of 35 %
    assert repaired(spark, [400, 600, 100, 610, 200, 300]) == "012345"  # two wraps
    assert repaired(spark, [400, 500, 100, 200], all={"structural": True}) == "0123"
    short = {"r3": {"words": 3}, "r4": {"label": "section_header"}}
    assert repaired(spark, [100, 200, 500, 150, 50], **short) == "40312"  # each before the first below it
    assert repaired(spark, [100, 200, 500, 150, 50]) == "01234"  # long texts stay
    away = {"r2": {"left": 300.0, "right": 400.0}, "r3": {"left": 300.0, "right": 400.0}}
    assert repaired(spark, [400, 500, 100, 200], **away) == "0123"  # another column
    centred = {"r2": {"left": 240.0, "right": 260.0, "marker": "IV"}, "r0": {"left": 0.0, "right": 90.0}, "r1": {"left": 0.0, "right": 90.0}}
    assert repaired(spark, [400, 500, 100, 200], **centred) == "2301"


def test_records_take_the_headings_they_show(spark):
    items = [("d", 0, 1, "a"), ("d", 1, None, None), ("d", 2, 2, "b"), ("d", 3, None, None), ("d", 4, None, None), ("d", 5, 2, "c"), ("d", 6, None, None)]
    frame = spark.createDataFrame([(d, i, level, False, True, False, t) for d, i, level, t in items], ITEMS)
    paths = lineage.heading_paths(frame, "doc", "ord")
    places = spark.createDataFrame([("d", i, 1, float(100 * i)) for i in range(6)] + [("d", 6, 1, 450.0)], "doc string, ord long, page int, top double")
    risen = {r.ord: r.path for r in lineage.risen_paths(places, paths, "doc", "ord").collect()}
    assert risen == {1: [0], 3: [0, 2], 4: [0, 2], 6: [0, 2]}  # the last item stands above heading 5
    refs = spark.createDataFrame([("d", 0, 1), ("d", 0, 3), ("d", 1, 4), ("d", 2, 6)], "doc string, record long, ord long")
    scopes = lineage.record_scopes(refs, lineage.risen_paths(places, paths, "doc", "ord"), "doc", "ord")
    assert {r.record: (r.path, r.conflict, r.rank) for r in scopes.collect()} == {0: ([0], True, 1), 1: ([0, 2], False, 4), 2: ([0, 2], False, 6)}
    titles = frame.where("level is not null").selectExpr("doc", "ord heading", "title")
    shown = spark.createDataFrame([("d", 1, "b", 1), ("d", 2, "a", 0), ("d", 2, "b", 1), ("d", 2, "odd", 2), ("d", 2, "odd", 2)], "doc string, record long, display string, n int")
    bound = lineage.heading_bindings(scopes, shown, titles, "doc")
    found = {r.record: (r.bound, r.missing, r.direct, r.unbound, r.valid) for r in bound.collect()}
    assert found == {0: ([], [0], [], [], False), 1: ([2], [0], [2], [], False), 2: ([0, 2], [], [0], ["odd", "odd"], False)}
    assert [r.heading for r in lineage.unclaimed_headings(paths, bound, "doc", "ord").collect()] == [5]


@pytest.mark.parametrize("most", [0, 4, 9])
def test_leads_are_joined_over_ranges(spark, most):
    rng = random.Random(most)
    texts = [None, "", "one", "one two", "ends here.", "a b c d e f g h i j k l", " . ", "three more words "]
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice(texts)) for i in range(300)]
    want = []
    for group in ("a", "b", None):
        held = None
        for g, at, text in rows:
            if g != group:
                continue
            n = len((text or "").split())
            if held and not held[2].rstrip().endswith(".") and held[3] + n <= most:
                held = [held[0], held[1] + 1, f"{held[2]} {text or ''}", held[3] + n]
            else:
                want += [(group, *held[:3])] if held else []
                held = [at, 1, text or "", n]
        want.append((group, *held[:3]))
    found = ingest.joined_leads(spark.createDataFrame(rows, "g string, o int, text string"), "g", "o", most)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))


def test_questions_have_the_record_before(spark):
    rows = [("a", 1, "x", "before?"), ("a", 2, "notes_and_questions", "Why so? no. And  how?"), ("b", 1, "notes_and_questions", "Is it? "), ("a", 3, "notes_and_questions", "Last?"), ("a", 0, "x", None)]
    found = ingest.questions(spark.createDataFrame(rows, "g string, o int, content_type string, text string"), "g", "o").collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, [("a", 2, "before?", 0, "Why so?"), ("a", 2, "before?", 1, "And how?"), ("a", 3, "Why so? no. And  how?", 0, "Last?"), ("b", 1, None, 0, "Is it?")]))
