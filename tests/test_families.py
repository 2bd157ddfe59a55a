"""The audit of table families against a plain walk over the records."""

import random
from collections import defaultdict

import pytest

from corpusmill.functions.udfs import parse_table
from corpusmill.operators import families

SHARED = ["content_type", "content_source", "source_file", "page_start", "page_end", "page_range"]
SCHEMA = ", ".join(f"{c} {kind}" for c, kind in families.COLUMNS.items())


def walked(rows, least=4, cap=10_000, dimensions=None):
    """(ord, issue): the rules one record after another, as plain Python."""
    out, kin, sources, alike, child_seen, children = set(), defaultdict(lambda: ([], [])), defaultdict(list), defaultdict(list), False, []
    for r in rows:
        say = lambda issue, r=r: out.add((r["ord"], issue))
        if r["malformed"] and "metadata" in r["malformed"]:
            say("invalid_metadata")
            continue
        role, tab = r["retrieval_role"], r["content_type"] == "table" and r["content_source"] == "table"
        child = role == "table_child"
        if not child and child_seen:
            say("canonical_record_after_children")
        child_seen |= child
        table = parse_table(r["text"]) if tab and not child else None
        if table:
            named = {x[0] for x in r["refs"] or [] if x[1] == "table" and x[0]}
            key = ("ref", r["source_file"] or "", *named) if len(named) == 1 else ("record", "", r["stable_id"])
            sources[key].append((r, table))
            refs = tuple(sorted({x[0] for x in r["refs"] or [] if x[0]}))
            alike[key, r["text"], r["source_file"], r["page_start"], r["page_end"], r["page_range"], refs].append(r)
        if "occurrence" in (r["malformed"] or []) or (r["occurrence"] or 0) < 0:
            say("invalid_table_fragment_occurrence")
        if r["occurrence"] is not None and not child and not table:
            say("unexpected_table_fragment_occurrence")
        if "recovered" in (r["malformed"] or []):
            say("invalid_table_recovery_flag")
        if role is None:
            if any(r[c] is not None for c in ("schema_version", "parent_id", "child_index", "child_count", "source_rows", "source_fragments")):
                say("orphan_retrieval_fields")
            continue
        if role not in ("table_parent", "table_child"):
            say("unknown_retrieval_role")
            continue
        if r["schema_version"] != 1:
            say("schema_version_mismatch")
        if not tab:
            say("non_table_retrieval_record")
        family = r["parent_id"]
        if not family:
            say("invalid_parent_stable_id")
            family = ("none", r["ord"])
        kin[family][child].append(r)
        if (r["child_count"] or 0) < 1:
            say("invalid_child_count")
        elif r["child_count"] > 128:
            say("declared_child_count_exceeds_parent_cap")
        if not child:
            if family != r["stable_id"]:
                say("parent_identity_mismatch")
            if r["child_index"] is not None:
                say("parent_has_child_index")
            if not table:
                say("invalid_parent_table")
            else:
                if r["table_rows"] != len(table["rows"]):
                    say("parent_table_rows_mismatch")
                if r["table_cols"] != table["column_count"]:
                    say("parent_table_cols_mismatch")
        else:
            children.append(r)
            if r["child_index"] is None or r["child_index"] < 0:
                say("invalid_child_index")
            own = parse_table(r["text"])
            if not own or len(own["rows"]) != 1:
                say("invalid_child_table")
            else:
                if r["table_rows"] != 1:
                    say("child_table_rows_mismatch")
                if r["table_cols"] != own["column_count"]:
                    say("child_table_cols_mismatch")
        for c, name in (("source_rows", "row"), ("source_fragments", "fragment")):
            if (r[c] or 0) < 1:
                say(f"invalid_table_source_{name}_count")
    out |= {(r["ord"], "corpus_child_count_exceeds_cap") for r in children[cap:]}
    for group in alike.values():
        numbers = [r["occurrence"] for r in group]
        if len(group) > 1 and numbers != list(range(len(group))):
            out |= {(r["ord"], "table_fragment_occurrences_invalid") for r in group}
        elif len(group) == 1 and numbers[0] is not None:
            out.add((group[0]["ord"], "unexpected_table_fragment_occurrence"))
    for key, parts in sources.items():
        n = sum(len(t["rows"]) for _, t in parts)
        recovered = {bool(r["recovered"]) for r, _ in parts}
        size = (dimensions or {}).get(key[2]) if key[0] == "ref" and True not in recovered else None
        for r, _ in parts:
            say = lambda issue, r=r: out.add((r["ord"], issue))
            if len({(tuple(t["preamble"]), t["header"], t["separator"]) for _, t in parts}) > 1:
                say("source_table_schema_mismatch")
            if len(recovered) > 1:
                say("source_table_recovery_mismatch")
            if size and size[0] != n:
                say("source_native_row_count_mismatch")
            if size and any(t["column_count"] != size[1] for _, t in parts):
                say("source_native_column_count_mismatch")
            parent = r["retrieval_role"] == "table_parent"
            if kin and n >= least and not parent:
                say("eligible_source_table_not_expanded")
            if parent and n < least:
                say("ineligible_source_table_expanded")
            if parent and r["source_rows"] != n:
                say("source_table_row_count_mismatch")
            if parent and r["source_fragments"] != len(parts):
                say("source_table_fragment_count_mismatch")
    for parents, own in kin.values():
        if len(own) > 128:
            out |= {(r["ord"], "family_child_count_exceeds_parent_cap") for r in parents or own[:1]}
        if len(parents) != 1:
            out |= {(r["ord"], "duplicate_parent" if parents else "missing_parent") for r in parents + own}
            continue
        p, n = parents[0], parents[0]["child_count"]
        if (n or 0) < 1:
            continue
        if len(own) != n:
            out.add((p["ord"], "family_child_count_mismatch"))
        for r in own:
            if r["child_count"] != n:
                out.add((r["ord"], "child_count_mismatch"))
            if any(r[c] != p[c] for c in SHARED):
                out.add((r["ord"], "family_metadata_mismatch"))
        if [r["child_index"] for r in own if (r["child_index"] if r["child_index"] is not None else -1) >= 0] != list(range(n)):
            out.add((p["ord"], "family_child_indexes_invalid"))
        table = parse_table(p["text"])
        if not table or len(table["rows"]) != n:
            out.add((p["ord"], "parent_row_count_mismatch"))
            continue
        for r in own:
            at = r["child_index"]
            if at is not None and 0 <= at < n and (r["text"] or "") != "\n".join([*table["preamble"], table["header"], table["separator"], table["rows"][at]]):
                out.add((r["ord"], "child_text_mismatch"))
    return out


def sound(tables):
    """Records of tables (ref, rows of each fragment) with their children, breaking no rule."""
    parents, children = [], []
    for ref, parts in tables:
        for k, n in enumerate(parts):
            rows = [f"| {ref} | {k}-{i} |" for i in range(n)]
            head = ["Caption", "| a | b |", "|---|---|"]
            parent = dict.fromkeys(families.COLUMNS)
            parent |= dict(stable_id=f"{ref}-{k}", text="\n".join(head + rows), content_type="table", content_source="table", source_file="f", page_start=k, refs=[(ref, "table"), ("x", "text")])
            if sum(parts) >= 4:
                parent |= dict(retrieval_role="table_parent", schema_version=1, parent_id=f"{ref}-{k}", child_count=n, table_rows=n, table_cols=2, source_rows=sum(parts), source_fragments=len(parts))
                for i, row in enumerate(rows):
                    children.append(parent | dict(stable_id=None, retrieval_role="table_child", text="\n".join([*head, row]), child_index=i, table_rows=1))
            parents.append(parent)
    plain = [dict.fromkeys(families.COLUMNS) | dict(stable_id="p", text="plain", content_type="case")]
    return [r | {"ord": i} for i, r in enumerate(parents + plain + children)]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def audited(spark, rows, **more):
    return {(r.ord, r.issue) for r in families.family_audit(frame(spark, rows), **more).collect()}


def test_sound_families_have_no_issues(spark):
    rows = sound([("t1", [5]), ("t2", [2, 3]), ("t3", [2])])
    assert audited(spark, rows) == walked(rows) == set()
    assert audited(spark, []) == set()
    counts = families.family_counts(frame(spark, rows)).first()
    assert tuple(counts) == (4, 3, 10)


@pytest.mark.parametrize("seed", range(4))
def test_broken_families(spark, seed):
    rng = random.Random(seed)
    rows = sound([(f"t{i}", [rng.randrange(1, 6) for _ in range(rng.randrange(1, 4))]) for i in range(14)] + [("big", [140])])
    values = {
        "retrieval_role": ["table_parent", "table_child", None, "odd"], "content_type": ["case", None], "schema_version": [None, 2], "parent_id": [None, "", "t1-0", "gone"],
        "child_index": [None, -1, 0, 1, 99], "child_count": [None, 0, 1, 3, 200], "table_rows": [None, 1, 7], "table_cols": [None, 9], "source_rows": [None, 0, 50],
        "source_fragments": [None, -1, 9], "occurrence": [None, 0, 1, -1], "recovered": [True, False, None], "source_file": ["g", None], "page_start": [None, 0],
        "text": [None, "", "| a | b |\n|---|---|\n| 1 | 2 |", "| a |\n|---|\n| 1 |"], "refs": [None, [], [("t1", "table")], [("t1", "table"), ("t2", "table")]],
        "malformed": [["metadata"], ["recovered"], ["occurrence"]], "stable_id": ["t1-0", "other"],
    }
    for _ in range(90):
        field = rng.choice(list(values))
        rng.choice(rows)[field] = rng.choice(values[field])
    rows += [dict(rng.choice(rows)) for _ in range(6)]
    order = sorted(rows, key=lambda r: rng.random() if rng.random() < 0.05 else 0)
    rows = [r | {"ord": i} for i, r in enumerate(order)]
    sizes = {"t1": (5, 2), "t2": (99, 9)}
    dimensions = spark.createDataFrame([(k, *v) for k, v in sizes.items()], "ref string, rows int, cols int")
    assert audited(spark, rows, of_all=60, dimensions=dimensions) == walked(rows, cap=60, dimensions=sizes)


def test_only_sound_families_are_attested(spark):
    rows = [r | {"stable_id": r["stable_id"] or f"child-{r['ord']}"} for r in sound([("t1", [5]), ("t3", [2])])]
    found = families.attested_families(frame(spark, rows), "a" * 64, " ids ").collect()
    assert [(r.parent_id, r.members, r.corpus_sha256, r.record_count, r.id_scheme) for r in found] == [("t1-0", [*(f"child-{i}" for i in range(3, 8)), "t1-0"], "a" * 64, 8, "ids")]
    broken = [r | {"child_count": 9} if r["ord"] == 4 else r for r in rows]
    with pytest.raises(ValueError, match="child_count_mismatch"):
        families.attested_families(frame(spark, broken), "a" * 64, "ids")
    for digest, scheme in (("A" * 64, "ids"), ("a" * 64, " "), (None, "ids")):
        with pytest.raises(ValueError):
            families.attested_families(frame(spark, rows), digest, scheme)
