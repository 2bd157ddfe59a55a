"""Toxicity by cumulative-link (proportional-odds) ordinal regression.

Features are sparse: every distinct word of a text gives its own feature and those of its
character 5-grams (with the word's borders).  One weight vector w is shared by all ordered
thresholds: P(grade > k) = sigmoid(w . x - cut_k).  The answer is the expected severity, the
sum of these probabilities over k.  Weights are kept from going below zero: words add evidence
and never take it away, so that long texts are not excused by their other words.

The model is fitted on a bounded sample of labelled rows: at most ``per_class`` toxic and
``per_class`` clean ones, least id hash first.  Labels that are only 0 or 1 are graded first:
0 stays 0, and toxic rows are split into ``grades`` - 1 equal parts by their score under a fit
with a single threshold.  Everything else covers all rows.

Defined results: null and empty texts, and any text where nothing can be fitted, have severity 0
and stay; conflicting labels of an id count as the highest; labels with a null id or label are
left out; repeated rows each stand; columns named like the outputs are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, forget_memos, portions, reread

WORD = re.compile(r"[^\W_]+")
#: Longest word part that is looked at whole; longer words are seen through the n-grams of all their parts.
GRAM = 5
SPACE = 1 << 20
#: A feature is looked at from so many toxic rows, log odds and z score on; the strongest so many.
LEAST_SEEN, LEAST_ODDS, LEAST_STRENGTH, MOST_FEATURES = 4, 2.0, 4.0, 1500


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word."""
    marked = f"<{word}>"
    grams = {marked} | {marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1)}
    return [zlib.crc32(g.encode("utf-8", "replace")) % SPACE for g in grams]


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class OrdinalModel:
    weights: dict[int, float]
    cuts: list[float]

    def word_score(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def severity(self, score: float) -> float:
        import math

        return sum(1 / (1 + math.exp(-max(-60.0, min(60.0, score - c)))) for c in self.cuts)


class Scorer:
    """Scores texts; scores of words are remembered in two bounded generations."""

    def __init__(self, model: OrdinalModel, size: int = 100_000):
        self.model, self.size, self.young, self.old = model, size, {}, {}

    def score(self, text: str | None) -> float:
        own = words(text)
        found = list(map(self.young.get, own))
        if None in found:
            for w, v in zip(own, found):
                if v is None:
                    v = self.old.get(w)
                    self.young[w] = self.model.word_score(w) if v is None else v
            found = list(map(self.young.get, own))
            if len(self.young) > self.size:
                self.old, self.young = self.young, {}
        return sum(sorted(found))


def strengths(seen_up, seen_down, n_up: int, n_down: int):
    """How much oftener features are in rows above grade 0 than in others (z score; 0 for rare or weak ones)."""
    import numpy as np

    share_up, share_down = (seen_up + 0.5) / (n_up + 1), (seen_down + 0.5) / (n_down + 1)
    pooled = (seen_up + seen_down + 1) / (n_up + n_down + 2)
    z = (share_up - share_down) / np.sqrt(pooled * (1 - pooled) * (1 / n_up + 1 / n_down) + 1e-12)
    return np.where((seen_up >= LEAST_SEEN) & (np.log(share_up / share_down) > LEAST_ODDS), z, 0)


def chosen_features(features, seen_up, seen_down, n_up: int, n_down: int):
    """The features, ascending, that the model looks at: at most ``MOST_FEATURES``, the strongest, ties to the smaller one."""
    import numpy as np

    if not len(features):
        return features
    strength = strengths(seen_up, seen_down, n_up, n_down)
    best = np.lexsort((features, -strength))[:MOST_FEATURES]
    return np.sort(features[best[strength[best] > LEAST_STRENGTH]])


def fit_matrix(x, grades, chosen, *, rounds: int = 400, penalty: float = 1e-4) -> OrdinalModel:
    """Weights of the ``chosen`` features from rows of counts ``x`` and their grades, by gradient descent with momentum (Adam)."""
    import numpy as np

    levels = np.unique(grades)
    if len(levels) < 2 or not len(chosen):
        return OrdinalModel({}, [])
    ranked = np.searchsorted(levels, grades)
    up = ranked > 0
    k = len(levels) - 1
    above = (ranked[:, None] > np.arange(k)).astype(np.float32)
    weigh = np.where(up, 0.5 / up.sum(), 0.5 / (~up).sum()).astype(np.float32)[:, None]
    w, cuts = np.zeros(len(chosen)), np.linspace(0.5, 1.5, k)
    state = np.zeros((2, len(w) + k))
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32))[:, None] - cuts, -30, 30)))
        slope = (p - above) * weigh
        grad = np.concatenate([x.T @ slope.sum(axis=1).astype(np.float32) + penalty * w, -slope.sum(axis=0)])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        move = 0.05 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        w = np.maximum(w - move[: len(w)], 0)
        cuts = np.sort(cuts - move[len(w) :])
    return OrdinalModel({int(f): round(float(v), 6) for f, v in zip(chosen, w)}, [round(float(c), 6) for c in cuts])


def graded(x, grades, chosen, parts: int):
    """The grades; if they are 0 and 1 only, the 1s become 1 .. parts-1 by equal parts of their score under a one-threshold fit."""
    import numpy as np

    first = fit_matrix(x, grades, chosen)
    if not first.weights or grades.max() > 1:
        return grades
    weights = np.array([first.weights[int(f)] for f in chosen])
    toxic = np.flatnonzero(grades)
    order = toxic[np.lexsort((toxic, np.round(x[toxic] @ weights, 6)))]
    out = grades.copy()
    out[order] = 1 + np.arange(len(order)) * (parts - 1) // len(order)
    return out


def fit(rows: list, grades: int = 4) -> OrdinalModel:
    """The model of rows (array of feature ids, repeated as often as they occur; grade) held in memory."""
    import numpy as np

    if not rows:
        return OrdinalModel({}, [])
    own = np.array([g for _, g in rows])
    sparse = [np.unique(f, return_counts=True) for f, _ in rows]
    every = np.unique(np.concatenate([f for f, _ in sparse]))
    up, down = (np.bincount(np.searchsorted(every, np.concatenate([f for (f, _), g in zip(sparse, own) if (g > own.min()) == side] or [every[:0]])), minlength=len(every)) for side in (True, False))
    n_up = int((own > own.min()).sum())
    if not n_up:
        return OrdinalModel({}, [])
    chosen = chosen_features(every, up, down, n_up, len(own) - n_up)
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, (f, n) in enumerate(sparse):
        _, mine, theirs = np.intersect1d(chosen, f, assume_unique=True, return_indices=True)
        x[i, mine] = n[theirs]
    return fit_matrix(x, graded(x, own, chosen, grades), chosen)


def _extract(batches):
    """Features of each text, repeated as often as its words hold them."""
    import pyarrow as pa

    for batch in portions(batches, 1):
        own = [array("i", sorted(f for w in words(t.as_py()) for f in features(w))).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["grade", "features"])


def _seen(batches):
    """How many texts above grade 0, and of others, hold each feature."""
    import numpy as np
    import pyarrow as pa

    counts = np.zeros((2, SPACE), np.int32)
    for batch in batches:
        for g, f in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[int(g <= 0), np.unique(np.frombuffer(f.as_py(), np.int32))] += 1
    held = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(held), 100_000):
        part = held[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[0, part].astype(np.int64)), pa.array(counts[1, part].astype(np.int64))], names=["feature", "up", "down"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = 2000, grades: int = 4) -> OrdinalModel:
    """The model of at most ``per_class`` clean and ``per_class`` toxic labelled ids of ``docs``, each with one of its rows.

    Features are counted and chosen on the cluster.  The driver gets counts of at most 2 x ``MOST_FEATURES`` of them and, for
    each sampled id, its counts of the chosen ones: at most 2 x per_class x ``MOST_FEATURES`` numbers (24 MB), however long the texts are.
    """
    import numpy as np

    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("grade"))
    picked = None
    for side in (F.col("grade") > 0, F.col("grade") <= 0):
        part = known.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    picked = cut(picked)  # at most 2 x per_class rows
    # one row of each id, of the least text by hash: repeated rows neither weigh more nor fill the driver
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    texts = found.groupBy("doc_id").agg(F.max("grade").alias("grade"), F.min_by("text", F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"))).alias("text"))
    texts = texts.select(F.greatest("grade", F.lit(0)).alias("grade"), "text")
    held = reread(texts.mapInArrow(_extract, "grade int, features binary"), "toxicity-sample")
    n_up, n_down = held.agg(F.count(F.when(F.col("grade") > 0, 1)), F.count(F.when(F.col("grade") <= 0, 1))).first()
    if not n_up or not n_down:
        return OrdinalModel({}, [])
    seen = held.mapInArrow(_seen, "feature int, up long, down long").groupBy("feature").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    share = lambda c, n: (F.col(c) + 0.5) / (n + 1)
    pooled = (F.col("up") + F.col("down") + 1) / (n_up + n_down + 2)
    z = (share("up", n_up) - share("down", n_down)) / F.sqrt(pooled * (1 - pooled) * (1 / n_up + 1 / n_down) + 1e-12)
    # a little wider than the rule itself, which is applied here to what comes
    likely = seen.where((F.col("up") >= LEAST_SEEN) & (F.log(share("up", n_up) / share("down", n_down)) > LEAST_ODDS - 0.01)).withColumn("z", z)
    found = likely.where(F.col("z") > LEAST_STRENGTH - 0.01).orderBy(F.desc("z"), "feature").limit(2 * MOST_FEATURES).toArrow()
    counts = [found.column(c).to_numpy() for c in ("feature", "up", "down")]
    chosen = chosen_features(*counts, n_up, n_down)
    if not len(chosen):
        return OrdinalModel({}, [])
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def columns(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            own = []
            for f in batch.column(1):
                ids, n = np.unique(np.frombuffer(f.as_py(), np.int32), return_counts=True)
                _, mine, theirs = np.intersect1d(sent.value, ids, assume_unique=True, return_indices=True)
                own.append(np.stack([mine, n[theirs]]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["grade", "counts"])

    rows = sorted(tuple(r) for r in held.mapInArrow(columns, "grade int, counts binary").toLocalIterator())
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, (_, packed) in enumerate(rows):
        at, n = np.frombuffer(packed, np.int32).reshape(2, -1)
        x[i, at] = n
    own = np.array([g for g, _ in rows])
    sent.unpersist()
    return fit_matrix(x, graded(x, own, chosen, grades), chosen)


def with_severity(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with ``severity``, the expected grade."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def severity(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget_memos()
        scorer = Scorer(sent.value)
        for texts in parts:
            yield pd.Series([sent.value.severity(scorer.score(t)) if t else 0.0 for t in texts], dtype="float64")

    return docs.withColumn("severity", severity(F.col(text)))


def toxicity_rows(docs: DataFrame, labels: DataFrame, reject_from: float = 0.5) -> DataFrame:
    """doc_id, severity and toxic (severity at or above ``reject_from``) of every row of ``docs``."""
    model = fit_toxicity(docs, labels)
    return with_severity(docs.select("doc_id", "text"), model).select("doc_id", F.round("severity", 6).alias("severity"), (F.col("severity") >= reject_from).alias("toxic"))


def civil_documents(docs: DataFrame, labels: DataFrame, reject_from: float = 0.5) -> DataFrame:
    """The documents, with their own columns, below ``reject_from``."""
    names = docs.columns
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text")
    return with_severity(kept, fit_toxicity(docs, labels)).where(F.col("severity") < reject_from).select("row.*")
