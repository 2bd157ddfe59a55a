"""Sharding, prefix tries and manifests, against brute force and their SQL twins."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import merkle, queries, ranges, sharding, turn_trie


def keyed(rows):
    return sorted((tuple(r) for r in rows), key=lambda t: tuple((v is not None, str(v)) for v in t))


def twin(sql, columns, name, df, tmp_path):
    """The twin's rows over ``df`` as the table ``name``."""
    pq.write_table(df.toArrow(), tmp_path / f"{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    return keyed(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


@pytest.mark.parametrize("name", ["op11_jump_shards", "op12_prefix_trie", "op13_merkle_manifest"])
def test_twins(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert keyed(df.collect()) == keyed(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_ranges_continue_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "a", "a", "b", "é"]), i, rng.getrandbits(63)) for i in range(400)]
    dealt = ranges.dealt(spark.createDataFrame(rows, "g string, i long, x long"), "g", ["i"], {"x": 3})
    edges = dealt.edges

    def run(batches):
        import pyarrow as pa

        found = ranges.placed(batches, edges, "g", {"x": 3})
        if found:
            more = [pa.array(found.place), pa.array(found.total), pa.array(found.group), pa.array(found.lanes[0].view("int64"))]
            yield from pa.Table.from_arrays([*found.table.columns, *more], names=["g", "i", "x", "place", "total", "number", "lane"]).combine_chunks().to_batches()

    got = dealt.rows.mapInArrow(run, "g string, i long, x long, place long, total long, number long, lane long").collect()
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    want = []
    for number, g in enumerate(groups):
        own, lane = sorted(r for r in rows if r[0] == g), 0
        for place, (_, i, x) in enumerate(own):
            lane = (lane + x * 3**place) % 2**64
            want.append((g, i, x, place, len(own), number, lane - 2**64 if lane >= 2**63 else lane))
    assert keyed(got) == keyed(want) and dealt.groups == len(groups)


def jumped(key, shards):
    """The hash as published, with Python's integers."""
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_balanced_and_moves_only_into_new_shards():
    keys = [*range(20_000), -1, -(2**63), 2**63 - 1]
    was = None
    for n in (1, 2, 24, 25, 1000):
        own = sharding.jump(keys, n).tolist()
        assert own[:300] == [jumped(k, n) for k in keys[:300]] and own[-3:] == [jumped(k, n) for k in keys[-3:]]
        if n == 24:
            counts = [own.count(s) for s in range(24)]
            assert min(counts) > 700 and max(counts) < 970
            was = own
        if n == 25:
            moved = [(a, b) for a, b in zip(was, own) if a != b]
            assert {b for _, b in moved} == {24} and abs(len(moved) - len(keys) / 25) < 150
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_shards_of_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, __part int"
    rows = [(i % 37 if i % 11 else None, [None, "", "ä\n", "x" * 70_000, "same"][i % 5], "l", "s", i, "own", 3) for i in range(200)]
    rows += [(5, "same", "l", "s", 1, "own", 3)] * 40 + [(-4, "n", "l", "s", 1, "own", 3)]
    docs = spark.createDataFrame(rows, schema)
    got = sharding.shard_digests(docs)
    found = got.collect()
    assert keyed((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in found) == keyed(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), jumped(i or 0, 24), jumped(i or 0, 25)) for i, t, *_ in rows
    )
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert keyed(found) == twin(sharding.oracle(), got.columns, "documents", docs, tmp_path)
    assert sharding.shard_digests(docs.limit(0)).count() == 0
    path, more = str(tmp_path / "shards"), str(tmp_path / "more")
    sharding.write_shards(docs, "doc_id", 5, path, files=3)
    back = spark.read.parquet(path)
    assert keyed((r.doc_id, r.text, r.shard) for r in back.collect()) == keyed((i, t, jumped(i or 0, 5)) for i, t, *_ in rows)
    sharding.grow_shards(spark, path, "doc_id", 5, 1, more)
    grown = spark.read.parquet(more)
    assert {r.shard for r in grown.collect()} <= {5} and grown.count() == sum(jumped(r[0] or 0, 6) == 5 for r in rows)


def brute_trie(rows):
    conv = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            conv[c].append(((turn is not None, turn or 0, sha), role, text))
    conv = {c: [t[1:] for t in sorted(v)] for c, v in conv.items()}
    rebuilt = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(conv.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    nodes, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    for s in nodes:
        if s:
            kids[s[:-1]].append(s)
    for s in sorted(nodes, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        own = (len(nodes[s]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        saved[s] = own + sum(saved[k] for k in kids[s])
    ends = lambda s, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(s)))).encode()).hexdigest()
    return [(min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], ends(s, m)) for s, m in nodes.items()]


TURNS = "conv_id long, turn long, role string, text string, idx string, a string, top int"


@pytest.mark.parametrize("settings", [{}, {"stretch": 2}, {"stretch": 3, "heavy": 3}, {"heavy": 5}, {"stretch": 1, "heavy": 2}], ids=str)
def test_trie_of_odd_conversations(spark, tmp_path, settings):
    rng = random.Random(3)
    rows = []
    for c in [*range(-23, 45), None, 60, 61, 62, 63, *range(100, 130)]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["u", "a", None]), rng.choice([None, "", "x y", "ä b c", "x y", "z " * 40_000]), "own", "own", 1))
    rows += [(c, t, "u", f"turn {t}", "own", "own", 1) for c in (80, 200, 201, 240) for t in range(12)] * 2
    df = spark.createDataFrame(rows, TURNS)
    got = turn_trie.prefix_trie(df, **settings)
    found = keyed(got.collect())
    assert found == keyed(brute_trie(rows))
    if not settings:
        assert found == twin(turn_trie.oracle(), got.columns, "conversations", df, tmp_path)


def test_trie_of_a_long_shared_conversation(spark):
    rows = [(c, t, "u", f"t{t if c < 30 else min(t, 70 + c)}", "", "", 0) for c in range(0, 61, 20) for t in range(150)]
    got = turn_trie.prefix_trie(spark.createDataFrame(rows, TURNS), stretch=16, heavy=20)
    assert keyed(got.collect()) == keyed(brute_trie(rows))


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "x", "", "", 0)], [(1, None, None, None, "", "", 0)], [(21, 0, "u", "x", "", "", 0)]], ids=len)
def test_trie_of_few_rows(spark, rows):
    got = turn_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert keyed(got) == (keyed(brute_trie(rows)) if any(r[0] is not None for r in rows) else [])


def brute_manifest(rows, arity=2):
    """(doc_id, leaf, subroot, root, digest of the proof, folded root, verified) of rows (doc_id, text, lang, source, n_chars)."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def leaf(doc_id, text, lang, source, n_chars, more=0):
        values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + arity])) for k in range(0, len(out[-1]), arity)])
        return out

    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for g in langs}
    trees = {g: tree([leaf(*r) for r in own[g]]) for g in langs}
    if not rows:
        return []
    top, out = tree([trees[g][-1][0] for g in langs]), []
    for g, lang in enumerate(langs):
        for i, r in enumerate(own[lang]):
            node, proof = leaf(*r, more=int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)), ""
            for levels, at in ((trees[lang], i), (top, g)):
                for nodes in levels[:-1]:
                    first = at - at % arity
                    run = nodes[first : first + arity]
                    proof += "".join(x for k, x in enumerate(run, first) if k != at)
                    run[at - first] = node
                    node, at = sha("".join(run)), at // arity
            out.append((r[0], leaf(*r), trees[lang][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, now string, __salt int"


@pytest.mark.parametrize("n, langs", [(0, 1), (1, 1), (2, 2), (7, 1), (33, 1), (40, 5), (100, 45), (60, 60)])
def test_manifest_of_odd_rows(spark, tmp_path, n, langs):
    rng = random.Random(n + langs)
    rows = []
    for _ in range(n):
        lang = rng.choice([None, "", *(f"é{k}" for k in range(langs))]) if langs > 1 else "x"
        rows.append((rng.choice([None, *range(-3, 40)]), rng.choice([None, "", "ä x", "b" * 50_000]), lang, rng.choice([None, "s"]), rng.choice([None, 3, 2**63 - 1]), "own", "own", 1))
    docs = spark.createDataFrame(rows, DOCS)
    got = merkle.proof_digests(docs)
    assert keyed(got.collect()) == keyed(brute_manifest([r[:5] for r in rows]))
    assert keyed(got.collect()) == twin(merkle.oracle(), got.columns, "documents", docs, tmp_path)


@pytest.mark.parametrize("arity", [3, 16])
def test_manifest_of_other_arity(spark, arity):
    rows = [(i, f"t{i}", "abc"[i % 3] if i < 90 else "a", None, i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    leaves = docs.select("doc_id", "lang", merkle.leaf_digest([F.col(c) for c in merkle.FIELDS]).alias("leaf"))
    built = merkle.manifest(leaves, "lang", "doc_id", "leaf", arity)
    want = {r[0]: r for r in brute_manifest(rows, arity)}
    assert {r[3] for r in want.values()} == {built.root.decode()}
    proofs = merkle.row_proofs(built, ["doc_id", "leaf"]).collect()
    assert len(proofs) == len(rows)
    for p in proofs:
        path = [(place, [x.encode() for x in level]) for place, level in zip(p.places, p.siblings)]
        assert merkle.fold(p.leaf.encode(), path) == built.root and p.subroot == want[p.doc_id][2]
        assert hashlib.sha256("".join(x for level in p.siblings for x in level).encode()).hexdigest() == want[p.doc_id][4]
        assert merkle.fold(b"0" * 64, path) != built.root


def test_fragments_merge_in_any_order():
    """The monoid: whatever order and grouping fragments are merged in, one root and the same folded nodes are left."""
    leaves = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(23)]
    parts = []
    for a, b in ((0, 5), (5, 6), (6, 13), (13, 14), (14, 23)):
        own = merkle.Stack.over(0, 23, a, b"".join(leaves[a:b]), 2)
        parts.append(merkle.Fragment(own.unresolved(), {0: 23, merkle.TOP: 1}))
    rng = random.Random(0)
    found = set()
    for _ in range(20):
        todo = rng.sample(parts, len(parts))
        while len(todo) > 1:
            i = rng.randrange(len(todo) - 1)
            todo[i : i + 2] = [merkle.merge(todo[i], todo[i + 1])]
        assert list(todo[0].nodes) == [(merkle.TOP, 0, 0)]
        found.add((todo[0].nodes[merkle.TOP, 0, 0], tuple(sorted(todo[0].folded))))
    assert len(found) == 1
