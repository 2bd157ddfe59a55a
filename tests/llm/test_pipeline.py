"""The whole pipeline over a planted corpus against plain Python, stage after stage."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F
from test_models import brute_kn, brute_survivors

from corpusmill.llm import toxicity
from corpusmill.llm.common import table


def judged_by_plain_python(rows, trusted, part):
    """The rows that the quality stage keeps: perplexities by recursion, limits by sorting."""
    texts = [r for r in rows if r["text"]]
    known = [r for r in texts if r["doc_id"] in trusted]
    perplexity = brute_kn([r["text"] for r in known if part[r["doc_id"]]])
    size = lambda t: len(t.encode("utf-16-le")) // 2 + 1
    held = [(r["lang"], perplexity(r["text"]), size(r["text"])) for r in known if not part[r["doc_id"]]]
    least = lambda values, q: sorted(values)[max(0, math.ceil(q * len(values)) - 1)]
    drawn = lambda own, every, n: (n * own + 100 * every) / (n + 100)
    steady = lambda p, n, prior: math.exp((n * math.log(p) + 200 * prior) / (n + 200))
    prior_all = math.log(least([p for _, p, _ in held], 0.5))
    limit_all = least([steady(p, n, prior_all) for _, p, n in held], 0.995) * 1.03
    langs = {lang: [(p, n) for own, p, n in held if own == lang] for lang in {h[0] for h in held} - {None}}
    priors = {lang: drawn(math.log(least([p for p, _ in own], 0.5)), prior_all, len(own)) for lang, own in langs.items()}
    limits = {lang: drawn(least([steady(p, n, priors[lang]) for p, n in own], 0.995) * 1.03, limit_all, len(own)) for lang, own in langs.items()}
    return [r for r in rows if not r["text"] or steady(perplexity(r["text"]), size(r["text"]), priors.get(r["lang"], prior_all)) <= limits.get(r["lang"], limit_all)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut_by_plain_python(rows, items):
    """The rows that decontamination keeps, with the passages of ten words and more that items hold taken out."""
    lower = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    windows = set()
    for text in items:
        words = [lower(w) for w in WORD.findall(text or "")]
        windows |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9) if words else 0)}
    sizes, out = {len(w) for w in windows}, []
    for r in rows:
        text = r["text"]
        places = [(m.start(), m.end()) for m in WORD.finditer(text or "")]
        words = [lower(text[a:b]) for a, b in places]
        hit = set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if len(hit) > len(words) / 2:
            continue
        if hit:
            pieces, at = [], 0
            for k in sorted(hit):
                if k - 1 not in hit:
                    pieces += [text[at : places[k][0]].rstrip(" "), " "]
                at = places[k][1]
            text = ("".join(pieces) + text[at:].lstrip(" ")).strip(" ")
            r = r | {"text": text, "n_chars": len(text)}
        out.append(r)
    return out


def test_the_pipeline_is_its_stages_in_plain_python(spark, sf_dir, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    import sentencepiece
    from public_tokenizers import path

    rng = random.Random(12)
    base = [r.asDict() for r in table(spark, sf_dir, "documents").collect()]
    items = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    labels = table(spark, sf_dir, "labels")
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    toxic = [r for r in base if known.get(r["doc_id"], (0, 0))[1]]
    good = [r for r in base if known.get(r["doc_id"], (0, 1)) == (1, 0) and len(r["text"].split()) > 60]
    planted = []
    for k in range(12):  # near copies, passages of items within clean text, texts that are mostly an item, junk, toxic copies
        words = rng.choice(good)["text"].split()
        words[len(words) // 2] = "changed"
        planted.append(" ".join(words))
        planted.append(rng.choice(good)["text"] + "\n\n" + items[k % len(items)] + "  And on it goes.")
        planted.append("Short lead. " + items[(k + 3) % len(items)])
        planted.append("".join(rng.choice("qxzj#%0") for _ in range(400)))
        planted.append(rng.choice(toxic)["text"] + " x")
    rows = base + [dict(doc_id=10_000 + i, text=t, lang=rng.choice(["en", "de", None]), source="planted", n_chars=len(t)) for i, t in enumerate(planted)]
    rows += [dict(doc_id=20_000, text=None, lang=None, source=None, n_chars=None), dict(doc_id=20_001, text="", lang="en", source="s", n_chars=0)]
    rows += [dict(good[0], doc_id=20_002), dict(good[1])]  # a copy, and a row that stands twice
    home = str(tmp_path / "planted")
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], table(spark, sf_dir, "documents").schema)
    docs.write.parquet(f"{home}/documents.parquet")
    labels.write.parquet(f"{home}/labels.parquet")
    table(spark, sf_dir, "benchmark").write.parquet(f"{home}/benchmark.parquet")

    model = toxicity.fit_toxicity(table(spark, home, "documents"), labels)

    def severity(text):
        score = sum(sorted(sum(model.weights.get(f, 0.0) for f in toxicity.features(w)) for w in toxicity.words(text)))
        return sum(1 / (1 + math.exp(c - score)) for c in model.cuts)

    civil = [r for r in rows if not r["text"] or severity(r["text"]) < 0.5]
    part = {r.doc_id: r.p for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("p")).collect()}
    fine = judged_by_plain_python(civil, {d for d, (q, _) in known.items() if q == 1}, part)
    staying = set(brute_survivors([(r["doc_id"], r["text"]) for r in fine]))
    one = list({r["doc_id"]: r for r in fine if r["doc_id"] in staying}.values())
    clean = cut_by_plain_python(one, items)
    assert len(rows) - 10 > len(civil) and len(civil) - 10 > len(fine) > len(one) > len(clean) > 100

    pieces = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    want = []
    for r in clean:
        ids = pieces.encode(r["text"] or "")
        want.append((r["doc_id"], r["lang"], r["source"], r["n_chars"], tuple(ids), len(ids), pieces.decode(ids)))
    found = pipeline.run(spark, home)
    got = [(r.doc_id, r.lang, r.source, r.n_chars, tuple(r.ids), r.n_tokens, r.text) for r in found.collect()]
    assert {g[0] for g in got} == {w[0] for w in want}
    assert sorted(got, key=str) == sorted(want, key=str)
