"""Quality classifier: interpolated modified Kneser-Ney character n-grams.

The model is trained on trusted text only.  Symbols are UTF-16 code units, so that four of
them fill one 64-bit key, newest symbol in the highest bits: the context is the low bits and
dropping the oldest symbol is a shift.  Counts of the highest order come from the text, those
of lower orders from the distinct n-grams above them (continuation counts); each order has its
three discounts from its counts of counts; contexts hand the discounted mass to the order
below, and the lowest order to a uniform spread.

Scoring is by sharded count joins: documents are dealt into shards of about ``shard_chars``
characters, each shard asks for its distinct n-grams once, asked n-grams are joined with the
counts of every order, and the answers come back to the shard.  No model or count table passes
through the driver; what is gathered grows with the text.

A few unusual symbols say little about a short text.  What is held against the threshold is the
perplexity with ``pseudo`` symbols added that cost the language's median.  A language's
threshold is a quantile of this over trusted texts that were held out of training, times
``slack``.  A language's median and limits are drawn towards those over all languages, as if
``shrink`` texts of all languages stood beside its own; null and unseen languages take those over all.

Defined results: null and empty texts have no perplexity and are kept; without trusted text
nothing is rejected; rows with a null doc_id are scored and never trusted; a doc_id labelled
more than once is trusted if all its labels are 1; repeated rows each stand; ``classify`` replaces columns
named like the outputs, ``good_documents`` keeps them; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import cut, lean, set_aside

ORDER = 4
BOS, EOS = 0xFFFE, 0xFFFF
#: Trusted ids are broadcast up to this many, about 64 MB; beyond, the join is a shuffle.
BROADCAST_IDS = 4_000_000
#: Partitions that shards are dealt to, at most; tasks take their shards one after another.
MOST_PARTITIONS = 50_000
SHARD = "__kn_shard"


def symbols(texts: list[str]):
    """Code units of the texts one after another, each with its borders, and where each begins."""
    import numpy as np

    edge, end = np.full(ORDER - 1, BOS, np.uint16), np.array([EOS], np.uint16)
    parts, starts, at = [], [], 0
    for t in texts:
        units = np.frombuffer(t.encode("utf-16-le"), "<u2")
        units = np.where(units >= BOS, np.uint16(0xFFFD), units) if len(units) and units.max() >= BOS else units
        parts += [edge, units, end]
        starts.append(at)
        at += len(units) + ORDER
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16), np.array(starts, np.int64)


def keys_of(units):
    """One key for every symbol that has a full context (others belong to borders)."""
    import numpy as np

    return np.ndarray((max(0, len(units) - ORDER + 1),), "<u8", buffer=units.tobytes(), strides=(2,)).copy()


def judged(units):
    """Whether each key's newest symbol is one to predict, not a border."""
    return units[ORDER - 1 :] != BOS


def _portions(texts: list[str], limit: int = 1_000_000):
    """Slices of the texts with about ``limit`` characters each."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


@lean
def _count(batches):
    """Partial counts of keys; a task's sums are handed on whenever they grow large."""
    import numpy as np
    import pyarrow as pa

    def merged(parts):
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([n for _, n in parts])
        unique, where = np.unique(keys, return_inverse=True)
        return unique, np.bincount(where, counts, len(unique)).astype(np.int64)

    parts, held = [], 0
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        for a, b in _portions(texts):
            units, _ = symbols(texts[a:b])
            keys, counts = np.unique(keys_of(units)[judged(units)], return_counts=True)
            parts.append((keys, counts))
            held += len(keys)
            if held > 2_000_000:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], names=["key", "n"])
                    parts, held = [], 0
    if parts:
        keys, counts = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])


@dataclass
class Model:
    """alpha (key, a) and gamma (context, g) of each order from the highest; the last mass and uniform share."""

    levels: list[tuple[DataFrame, DataFrame]]
    last_mass: float
    uniform: float


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts; fixed ones where counts of counts are missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), float(k)) for k, d in enumerate(found, 1))


def context_of(key: Column, order: int) -> Column:
    return key.bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))


def train(trusted: DataFrame, text: str = "text") -> Model:
    """Counts and weights of every order from the texts of ``trusted``."""
    counts = cut(trusted.select(text).mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    levels, last_mass, uniform = [], 1.0, 1.0 / 65536
    for order in range(ORDER, 0, -1):
        few = {r[0]: r[1] for r in counts.where("n <= 4").groupBy("n").count().collect()}
        d1, d2, d3 = discounts(*(few.get(k, 0) for k in (1, 2, 3, 4)))
        cut_off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        if order == 1:
            total, mass, kinds = counts.agg(F.sum("n"), F.sum(cut_off), F.count("*")).first()
            if total:
                last_mass, uniform = mass / total, 1.0 / (kinds + 1)
            levels.append((cut(counts.select("key", ((F.col("n") - cut_off) / F.lit(float(total or 1))).alias("a"))), None))
            break
        keyed = counts.withColumn("context", context_of(F.col("key"), order))
        sums = cut(keyed.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut_off).alias("mass")))
        alpha = keyed.join(sums, "context").select("key", ((F.col("n") - cut_off) / F.col("total")).alias("a"))
        levels.append((cut(alpha), sums.select("context", (F.col("mass") / F.col("total")).alias("g"))))
        counts = cut(counts.select(F.shiftrightunsigned("key", 16).alias("key")).groupBy("key").agg(F.count("*").alias("n")))
    return Model(levels, last_mass, uniform)


def resolved(asked: DataFrame, model: Model) -> DataFrame:
    """key and its log-probability ``lp`` for the distinct keys ``asked``."""
    out = asked.select("key")
    for i, (alpha, gamma) in enumerate(model.levels):
        order = ORDER - i
        own = F.col("key") if i == 0 else F.shiftrightunsigned("key", 16 * i)
        counted = alpha.select(F.col("key").alias("k"), F.col("a").alias(f"a{order}"))
        # single symbols: at most 65,536 rows
        out = out.withColumn("k", own).join(F.broadcast(counted) if order == 1 else counted, "k", "left")
        if gamma is not None:
            out = out.withColumn("c", context_of(F.col("k"), order)).join(gamma.select(F.col("context").alias("c"), F.col("g").alias(f"g{order}")), "c", "left").drop("c")
        out = out.drop("k")
    p = F.coalesce("a1", F.lit(0.0)) + F.lit(model.last_mass * model.uniform)
    for order in range(2, ORDER + 1):
        p = F.coalesce(f"a{order}", F.lit(0.0)) + F.coalesce(f"g{order}", F.lit(1.0)) * p
    return out.select("key", F.log(p).alias("lp"))


def perplexities(docs: DataFrame, model: Model, *, text: str = "text", shard_chars: int = 16_000_000) -> DataFrame:
    """``docs``, all columns and rows, with ``perplexity`` and ``n_symbols``, how many it is over."""
    names = [c for c in docs.columns if c not in ("perplexity", "n_symbols")]
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * shards, MOST_PARTITIONS))
    dealt = docs.select(*names, F.pmod(F.xxhash64(*[c for c in ("doc_id",) if c in names], text), F.lit(shards)).cast("int").alias(SHARD)).repartition(partitions, SHARD).sortWithinPartitions(SHARD)
    at_text, at_shard = names.index(text), len(names)

    @lean
    def ask(batches):
        import numpy as np
        import pyarrow as pa

        def distinct(shard, keys, texts):
            if texts:
                units, _ = symbols(texts)
                keys = np.union1d(keys, keys_of(units)[judged(units)])
            for a in range(0, len(keys), 100_000):
                part = keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard, np.int32)), pa.array(part.view(np.int64))], names=[SHARD, "key"])

        last, keys, texts, size = None, np.zeros(0, np.uint64), [], 0
        for batch in batches:
            for shard, t in zip(batch.column(at_shard).to_pylist(), batch.column(at_text)):
                if shard != last:
                    yield from distinct(last, keys, texts)
                    last, keys, texts, size = shard, np.zeros(0, np.uint64), [], 0
                if t := t.as_py():
                    texts.append(t)
                    size += len(t)
                    if size > 1_000_000:
                        units, _ = symbols(texts)
                        keys, texts, size = np.union1d(keys, keys_of(units)[judged(units)]), [], 0
        yield from distinct(last, keys, texts)

    def score(left, right):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(keys := right.column("key").to_numpy().view(np.uint64))
        keys, lp = keys[order], right.column("lp").to_numpy()[order]
        every = left.column(text).to_pylist()
        full = np.array([i for i, t in enumerate(every) if t], np.int64)
        texts = [every[i] for i in full]
        out, sizes = np.full(len(every), np.nan), np.zeros(len(every), np.int64)
        for a, b in _portions(texts):
            units, starts = symbols(texts[a:b])
            own = keys_of(units)
            good = judged(units)
            value = np.zeros(len(own) + 1)
            where = np.searchsorted(keys, own[good])
            if where.max() >= len(keys) or (keys[where] != own[good]).any():
                raise RuntimeError("an n-gram has no answer")
            value[:-1][good] = lp[where]
            ends = np.append(starts[1:], len(units))
            sums = np.add.reduceat(value, starts)
            n = ends - starts - ORDER + 1
            out[full[a:b]] = np.exp(-sums / n)
            sizes[full[a:b]] = n
        return left.select(names).append_column("perplexity", pa.array(out, pa.float64(), from_pandas=True)).append_column("n_symbols", pa.array(sizes))

    asked = dealt.mapInArrow(ask, f"{SHARD} int, key long")
    answers = asked.join(resolved(asked.select("key").distinct(), model), "key").select(SHARD, "key", "lp")
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField("perplexity", T.DoubleType()), T.StructField("n_symbols", T.LongType())])
    return dealt.groupBy(SHARD).cogroup(answers.groupBy(SHARD)).applyInArrow(score, schema)


def trusted_of(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Rows of ``docs`` whose doc_id has labels, all of them 1."""
    ids = cut(labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce(label, F.lit(0))).alias("q")).where("q = 1").select("doc_id"))
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def steadied(prior: Column, pseudo: int) -> Column:
    """The perplexity with ``pseudo`` symbols of log-cost ``prior`` added."""
    n = F.col("n_symbols")
    return F.exp((n * F.log("perplexity") + pseudo * prior) / (n + pseudo))


def thresholds(held_out: DataFrame, model: Model, *, quantile: float, slack: float, shrink: int, pseudo: int) -> DataFrame:
    """lang, prior (median log-cost) and threshold of every language with held-out texts, and of null: all."""
    scored = cut(perplexities(held_out.select("doc_id", "lang", "text"), model).select("lang", "perplexity", "n_symbols").where("perplexity is not null"))
    both = scored.where("lang is not null").union(scored.withColumn("lang", F.lit(None).cast("string")))
    drawn = lambda own, over_all: (F.col("n") * F.col(own) + shrink * F.lit(over_all)) / (F.col("n") + shrink)
    medians = cut(both.groupBy("lang").agg(F.log(F.percentile_approx("perplexity", 0.5, 10000)).alias("own"), F.count("*").alias("n")))
    over_all = medians.where("lang is null").first()
    priors = cut(medians.select(F.col("lang").alias("l"), "n", drawn("own", over_all and over_all["own"]).alias("prior")))
    steady = both.join(F.broadcast(priors), F.col("lang").eqNullSafe(F.col("l")))
    value = steadied(F.col("prior"), pseudo)
    limits = cut(steady.groupBy("lang", "n", "prior").agg((F.percentile_approx(value, quantile, 10000) * slack).alias("high")))
    over_all = limits.where("lang is null").first()
    return cut(limits.select("lang", "prior", drawn("high", over_all and over_all["high"]).alias("threshold")))


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.995, slack: float = 1.03, held_out_part: int = 5, shrink: int = 100, pseudo: int = 200) -> DataFrame:
    """``docs`` with perplexity, judged (the value held against the threshold), threshold and keep."""
    names = [c for c in docs.columns if c not in ("perplexity", "judged", "threshold", "keep")]
    trusted = trusted_of(docs.select("doc_id", "lang", "text"), labels)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(held_out_part)) == 0
    model = train(trusted.where(~held))
    limits = thresholds(trusted.where(held), model, quantile=quantile, slack=slack, shrink=shrink, pseudo=pseudo)
    over_all = limits.where("lang is null").first()
    prior_all, limit_all = (over_all["prior"], over_all["threshold"]) if over_all else (None, None)
    own = limits.where("lang is not null").select(F.col("lang").alias("__lang"), F.col("prior").alias("__prior"), F.col("threshold").alias("__limit"))
    scored = perplexities(docs.select(*[F.col(f"`{c}`") for c in names]), model)
    joined = scored.join(F.broadcast(own) if own.count() <= 10_000 else own, scored["lang"] == F.col("__lang"), "left")
    limit = F.coalesce("__limit", F.lit(limit_all).cast("double"))
    value = steadied(F.coalesce("__prior", F.lit(prior_all).cast("double")), pseudo)
    kept = [scored[f"`{c}`"] for c in names]
    return joined.select(*kept, "perplexity", value.alias("judged"), limit.alias("threshold"), F.coalesce(value <= limit, F.lit(True)).alias("keep"))


def quality_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs.select("doc_id", "lang", "text"), labels).select("doc_id", "lang", "perplexity", "judged", "threshold", "keep")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their own columns, that the classifier keeps."""
    plain, own = set_aside(docs, ("doc_id", "lang", "text"))
    return classify(plain, labels).where("keep").select(*own)
