"""Encoding, storage, decontamination and near-duplicates against brute force."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("public_tokenizers")
from corpusmill.llm import decontam, piece_codec, simhash_dedup, token_store
from corpusmill.llm.common import table

import public_tokenizers

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "    x", "a  b\n\n c ", "▁y▁", "\t\x00\x1c", "ﬁ ½ é é ́b", "İstanbul K ß", "don't 'Tis they'll''s", "<|endoftext|> <|ENDOFTEXT|>", "x,y. z., a.,b 12,5", "日本語 \U0001f600 w　v\u0085u", "the " * 3000, "z" * 5000]


def odd_docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "x"), (None, "no id", "y"), (None, None, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_agenda_equals_the_library(spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = piece_codec.MergeVocabulary(PIECES)
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab ▁\n.tehé ") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        assert memoryview(vocabulary.encode(t)).cast("i").tolist() == library.encode(t), repr(t)
        assert vocabulary.merge(("▁" + t.replace(" ", "▁")) if t else "") == library.encode(t)
    for docs in (table(spark, sf_dir, "documents"), odd_docs(spark), odd_docs(spark).limit(0)):
        want = []
        for r in docs.collect():
            ids = library.encode(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        got = [tuple(r) for r in piece_codec.piece_digests(docs, PIECES).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    import numpy as np

    for n in (0, 1, 7, 65536, 70001):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4").tobytes()
        assert token_store.unpack_segment(token_store.pack_segment(ids, 1000, bits)) == ids


def test_token_store(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    encoder = token_store.WordEncoder(WORDS)
    for t in ODD:
        assert memoryview(encoder.encode(t or "")).cast("I").tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
    docs = table(spark, sf_dir, "documents")
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted(tuple(r) for r in token_store.token_digests(docs, WORDS).collect()) == want
    path = token_store.write_tokens(odd_docs(spark), WORDS, segment_ids=100, block_ids=64, bits=True)
    back = token_store.read_tokens(spark, path).orderBy("start").collect()
    assert len(back) == len(ODD) + 3 and back[0].doc_id is None
    assert [r.start for r in back] == [sum(x.n_tokens for x in back[:i]) for i in range(len(back))]
    assert token_store.token_digests(odd_docs(spark).limit(0), WORDS).count() == 0


def brute_contamination(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = split(t)
        hit, named = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    named |= found
        named = sorted(str(x) for x in named if x is not None)
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_many_groups_and_long_items(spark, monkeypatch):
    """Items cut into pieces, more groups than a worker keeps, and more than a stage takes, hit what whole items hit."""
    rng = random.Random(8)
    words = ["a", "b", "c", "d9", "é"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([4, 12, 15, 90, 200])))) for i in range(25)]
    items += [(100 + i, items[i][1]) for i in range(5)] + [(None, items[0][1]), (7, "")]
    docs = [(i, " ".join(rng.choice(items)[1][rng.randint(0, 60) :][: rng.randint(0, 200)] for _ in range(3))) for i in range(30)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(docs, items)
    for at_once in (64, 4):
        monkeypatch.setattr(decontam, "GROUPS_AT_ONCE", at_once)
        found = decontam.match_spans(a, b, group_words=20).collect()
        got = []
        for r in found:
            names = sorted(r["items"])
            got.append((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(r.spans)))
        assert sorted(got, key=str) == want


def test_automata_are_linear_in_their_items():
    import time

    began = time.time()
    for text in ("a " * 60_000, "a b " * 30_000, " ".join(str(i % 500) for i in range(60_000))):
        own = decontam.SuffixAutomaton([text.encode().split()] + [f"{k} x y z".encode().split() for k in range(500)])
        assert len(own.length) < 2 * 63_000 and sum(map(len, own.held.values())) <= 63_000 and sum(map(len, own.short.values())) < 10_000
    many = decontam.SuffixAutomaton([f"{k} {'same ' * 20}".encode().split() for k in range(2000)])
    assert sum(map(len, many.held.values())) <= 2000 * 21
    assert time.time() - began < 30


def test_decontamination(spark, sf_dir):
    rng = random.Random(5)
    words = ["a", "b", "c", "ab", "é9"]
    for group in (2_000_000, 30):
        items = [(i % 25 if i else None, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 6, 10, 12, 30])) if True) or None) for i in range(40)]
        items += [(77, "b " * 15), (78, "One two three four five six seven eight nine TEN eleven")]
        docs = [(i, " ".join(rng.choice([*words, "zz", "Zz."]) for _ in range(rng.randint(0, 120)))) for i in range(60)]
        docs += [(5, "b b b"), (None, None), (None, "x one TWO three, four five six seven eight nine ten."), (9, ""), (10, "b " * 4000)]
        a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
        b = spark.createDataFrame(items, "item_id long, text string")
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        few = decontam.match_spans(a, b, group_words=group)
        assert few.count() == len(docs)
        got = sorted((tuple(r[n] for n in names) for r in decontam.contamination_digests(a, b).collect()), key=str)
        assert got == brute_contamination(docs, items)
        both = {tuple(map(str, (r.doc_id, r.n_words, r.spans, sorted(r.items)))) for r in few.collect()}
        whole = {tuple(map(str, (r.doc_id, r.n_words, r.spans, sorted(r.items)))) for r in decontam.match_spans(a, b).collect()}
        assert both == whole
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = sorted((tuple(r[n] for n in names) for r in decontam.contamination_digests(docs, items).collect()), key=str)
    assert got == brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sum(r[-1] for r in got) > 0
    clean = decontam.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert not any(r.contaminated for r in decontam.contamination_digests(clean, items).collect())
    assert decontam.contamination_digests(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in decontam.contamination_digests(docs, items.limit(0)).collect())


def brute_simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=2):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(((d, f"{fp:016x}", min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, fp) in enumerate(rows)), key=str)


def test_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edge = spark.createDataFrame([(900001, None), (900002, ""), (900003, "One  two"), (900004, "one two"), (None, "one two"), (900004, "one two"), (None, "alone with no id here")], docs.schema)
    every = docs.union(edge)
    got = sorted((tuple(r) for r in simhash_dedup.near_duplicates(every).collect()), key=str)
    assert got == brute_components([(r.doc_id, brute_simhash(r.text)) for r in every.collect()])
    crowd, simhash_dedup.CROWD = simhash_dedup.CROWD, 1  # every fingerprint of two rows counts as crowded
    try:
        assert sorted((tuple(r) for r in simhash_dedup.near_duplicates(every).collect()), key=str) == got
    finally:
        simhash_dedup.CROWD = crowd
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash_dedup.deduplicated(every).collect()
    assert len(kept) == len({c if c is not None else f for _, f, c in got})


def test_forest_over_many_shards(spark):
    rng = random.Random(11)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(30):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
    for _ in range(500):  # a ball of very near fingerprints
        fps.add(rng.choice([1, 2, 4, 8]) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash_dedup.link_forest(df, sample=256, shard_rows=64)
    roots = dict(simhash_dedup.components(edges).collect())
    pairs = brute_components([(f, f % (1 << 64)) for f in signed])
    want, mine = {}, {}
    for d, _, c in pairs:
        want.setdefault(c, set()).add(d)
    for f in signed:
        mine.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def test_memos_are_bounded_by_bytes():
    from corpusmill.llm.common import ChunkMemo

    memo = ChunkMemo(lambda own: [c[::-1] * 2 for c in own], size=1000, most=60_000)
    rng = random.Random(1)
    for _ in range(400):
        chunks = [bytes([97 + rng.randrange(3)]) * rng.choice([1, 2, 100, 5000]) + str(rng.randrange(60)).encode() for _ in range(20)]
        assert memo.encode(chunks) == b"".join(c[::-1] * 2 for c in chunks)
        held = [sum(len(k) + len(v) for k, v in d.items()) for d in (memo.young, memo.old)]
        assert max(held) < 60_000 + 20 * 800 and all(len(k) <= 256 for d in (memo.young, memo.old) for k in d)


def test_workers_wait_with_nothing_held(spark):
    """A worker that waits after its task has no memo and no model, as others fill theirs beside it."""
    docs = spark.createDataFrame([(i, f"some words {i} and more") for i in range(64)], "doc_id long, text string").repartition(8)

    def held(batches):
        import pyarrow as pa

        from corpusmill.llm import common

        for _ in batches:
            pass
        entries = sum(len(memo.young) + len(memo.old) for memo in common._memos)
        yield pa.RecordBatch.from_arrays([pa.array([entries]), pa.array([sum(map(len, common._models))])], names=["entries", "models"])

    assert len(piece_codec.encode_decode(docs, PIECES, keep_memo=False).collect()) == 64
    got = spark.range(64).repartition(16).mapInArrow(held, "entries long, models long").collect()
    assert len(got) == 16 and not any(r.entries or r.models for r in got)
