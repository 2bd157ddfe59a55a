"""Ranking metrics, slices, significance and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import text as X


def graded(hits: DataFrame, qrels: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``hits`` (query_id, rank, doc_id) with ``relevance``; each positive judgment is credited once.

    ``aliases`` (query_id, judged_id, doc_id) names other ids that satisfy a judgment.  A judgment goes to the
    best-ranked hit; a hit that satisfies several takes the highest.
    """
    own = qrels.where("relevance > 0").select("query_id", F.col("doc_id").alias("judged_id"), "doc_id", "relevance")
    if aliases is not None:
        also = aliases.join(own.select("query_id", "judged_id", "relevance"), ["query_id", "judged_id"]).select("query_id", "judged_id", "doc_id", "relevance")
        own = own.unionByName(also).distinct()
    matched = hits.select("query_id", "rank", "doc_id").join(own, ["query_id", "doc_id"])
    first = matched.groupBy("query_id", "judged_id").agg(F.min("rank").alias("rank"), F.max("relevance").alias("relevance"))
    credit = first.groupBy("query_id", "rank").agg(F.max("relevance").alias("relevance"), F.count("*").alias("judgments"))
    return hits.join(credit, ["query_id", "rank"], "left").fillna({"relevance": 0.0, "judgments": 0})


def query_metrics(grades: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """One row a judged query: recall@k, ndcg@k, success@k, mrr and average precision."""
    positive = qrels.where("relevance > 0")
    total = positive.groupBy("query_id").agg(F.count("*").alias("total"))
    order = W.partitionBy("query_id").orderBy(F.col("relevance").desc(), "doc_id")
    ideal = positive.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(ks))
    best = ideal.groupBy("query_id").agg(*[F.sum(F.when(F.col("place") <= k, X.dcg_gain(F.col("relevance"), F.col("place")))).alias(f"ideal_{k}") for k in ks])
    seen = F.sum((F.col("relevance") > 0).cast("int")).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    ap = F.sum(F.when(F.col("relevance") > 0, F.col("seen") / F.col("rank")))
    first = F.min(F.when(F.col("relevance") > 0, F.col("rank")))
    at = lambda k, c: F.when(F.col("rank") <= k, c)
    got = (
        grades.withColumn("seen", seen)
        .groupBy("query_id")
        .agg(ap.alias("ap"), first.alias("first"), *[F.sum(at(k, F.col("judgments"))).alias(f"hit_{k}") for k in ks], *[F.sum(at(k, X.dcg_gain(F.col("relevance"), F.col("rank")))).alias(f"dcg_{k}") for k in ks])
    )
    every = total.join(best, "query_id").join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [F.col("query_id"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("ap") / F.col("total")).alias("average_precision")]
    for k in ks:
        out += [zero(F.col(f"hit_{k}") / F.col("total")).alias(f"recall_at_{k}"), zero(F.col(f"dcg_{k}") / F.col(f"ideal_{k}")).alias(f"ndcg_at_{k}"), zero((F.col("first") <= k).cast("double")).alias(f"success_at_{k}")]
    return every.select(*out)


def long_metrics(metrics: DataFrame) -> DataFrame:
    """query_id, metric, value."""
    return metrics.unpivot(["query_id"], [c for c in metrics.columns if c != "query_id"], "metric", "value")


def slice_rollup(metrics: DataFrame, slices: DataFrame) -> DataFrame:
    """slice, metric, mean and n_queries over (query_id, slice) pairs."""
    return long_metrics(metrics).join(slices.distinct(), "query_id").groupBy("slice", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n_queries"))


def gate(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """metric, observed, kind (min, max), bound and passed; a metric that is missing fails."""
    joined = limits.join(metrics.select("metric", F.col("value").alias("observed")), "metric", "left")
    held = F.when(F.col("kind") == "min", F.col("observed") >= F.col("bound")).otherwise(F.col("observed") <= F.col("bound"))
    return joined.select("metric", "observed", "kind", "bound", F.coalesce(held, F.lit(False)).alias("passed"))


def paired_bootstrap(pairs: DataFrame, by: str = "metric", resamples: int = 2000, seed: int = 20240601, confidence: float = 0.95) -> DataFrame:
    """Mean delta, percentile interval and smoothed two-sided p of (by, query_id, baseline, candidate) rows."""
    import random

    def run(key, pdf):
        import pandas as pd

        deltas = (pdf.sort_values("query_id").candidate - pdf.sort_values("query_id").baseline).tolist()
        rng, n = random.Random(seed), len(deltas)
        means = sorted(sum(deltas[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))

        def at(q):
            place = q * (resamples - 1)
            low = int(place)
            return means[low] + (place - low) * (means[min(low + 1, resamples - 1)] - means[low])

        below, above = sum(m <= 0 for m in means), sum(m >= 0 for m in means)
        tail = (1 - confidence) / 2
        return pd.DataFrame([[key[0], n, sum(deltas) / n, at(tail), at(1 - tail), min(1.0, 2 * (min(below, above) + 1) / (resamples + 1))]])

    kind = dict(pairs.dtypes)[by]
    return pairs.groupBy(by).applyInPandas(run, f"{by} {kind}, n_pairs long, mean_delta double, ci_low double, ci_high double, p_value double")


def normalised_judgments(queries: DataFrame) -> DataFrame:
    """query_id, id_type, judged_id, relevance, satisfying_id and match_kind (exact, accepted_table_child) of queries' judgments.

    ``queries``: query_id and judgments (array of chunk_id, source_id, relevance, accepted_children).  A judgment names a
    chunk or, without one, a source; only a chunk's table children may stand for it.
    """
    own = queries.select("query_id", F.explode("judgments").alias("j"))
    chunk, source = F.trim("j.chunk_id"), F.trim("j.source_id")
    named = own.select("query_id", F.when(chunk.isNotNull(), "chunk_id").otherwise("source_id").alias("id_type"), F.coalesce(chunk, source).alias("judged_id"), F.col("j.relevance").cast("double").alias("relevance"), F.when(chunk.isNotNull(), F.coalesce("j.accepted_children", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("children"))
    ids = F.array_distinct(F.concat(F.array("judged_id"), "children"))
    out = named.select("query_id", "id_type", "judged_id", "relevance", F.explode(ids).alias("satisfying_id"))
    return out.withColumn("match_kind", F.when(F.col("satisfying_id") == F.col("judged_id"), "exact").otherwise("accepted_table_child"))


def case_metrics(cases: DataFrame) -> DataFrame:
    """metric, value and n_queries over query cases, a metric only where it applies.

    ``cases``: expect_abstain, n_hits, first_relevant (its rank or null), top_type, expected_type, filtered, compliant.  An answerless
    query is right if it has no hits; type accuracy looks at the top hit; compliance is kept by an empty list.
    """
    answerless = F.col("expect_abstain")
    empty = F.col("n_hits") == 0
    rates = {
        "mrr": (~answerless, F.coalesce(1 / F.col("first_relevant"), F.lit(0.0))),
        "success_at_1": (~answerless, F.coalesce(F.col("first_relevant") <= 1, F.lit(False)).cast("double")),
        "success_at_10": (~answerless, F.coalesce(F.col("first_relevant") <= 10, F.lit(False)).cast("double")),
        "type_accuracy": (~answerless & F.col("expected_type").isNotNull(), F.coalesce(F.col("top_type") == F.col("expected_type"), F.lit(False)).cast("double")),
        "abstention_accuracy": (answerless, empty.cast("double")),
        "false_answer_rate": (answerless, (~empty).cast("double")),
        "filter_compliance": (F.col("filtered"), (empty | F.coalesce(F.col("compliant"), F.lit(False))).cast("double")),
    }
    lines = F.array_compact(F.array(*[F.when(applies, F.struct(F.lit(k).alias("metric"), v.alias("value"))) for k, (applies, v) in rates.items()]))
    return cases.select(F.explode(lines).alias("x")).groupBy("x.metric").agg(F.avg("x.value").alias("value"), F.count("*").alias("n_queries"))


def reported(metric: Column, value: Column) -> Column:
    """Means as reports show them: rounded, but safety rates exact, so that rare failures show."""
    return F.when(metric.isin("abstention_accuracy", "false_answer_rate", "filter_compliance"), value).otherwise(F.round(value, 3))


def regressions(metrics: DataFrame, baseline: DataFrame, tolerances: DataFrame) -> DataFrame:
    """metric, observed, prior, tolerance and status: passed, regressed, or absent from the current or the baseline report."""
    own = lambda df, name: df.select("metric", F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value")).alias(name))
    both = tolerances.join(own(metrics, "observed"), "metric", "left").join(own(baseline, "prior"), "metric", "left")
    status = F.when(F.col("observed").isNull(), "absent_from_current").when(F.col("prior").isNull(), "absent_from_baseline").when(F.col("prior") - F.col("observed") > F.col("tolerance"), "regressed").otherwise("passed")
    return both.select("metric", "observed", "prior", "tolerance", status.alias("status"))


def metric_limits(values: list[str]) -> dict[str, float]:
    """Limits given as ``metric=value``; a value must be finite and not negative."""
    out = {}
    for v in values:
        name, mark, raw = v.rpartition("=")
        try:
            limit = float(raw)
        except ValueError:
            limit = -1.0
        if not mark or not name.strip() or not 0 <= limit < float("inf"):
            raise ValueError(f"not a metric's limit: {v}")
        out[name.strip()] = limit
    return out


def pin_issues(queries: DataFrame, sha256: str, n_records: int) -> DataFrame:
    """query_id and issue of queries (query_id, sha256, record_count) that do not pin this corpus.

    Once any query declares a corpus, all must, with a whole digest and a count; and the declarations must agree.
    """
    whole = F.coalesce(F.col("sha256").rlike("^[0-9A-Fa-f]{64}$"), F.lit(False)) & F.coalesce(F.col("record_count") >= 1, F.lit(False))
    seen = queries.agg(F.countDistinct(F.lower("sha256")).alias("__d"), F.countDistinct("record_count").alias("__c"), F.max(F.col("sha256").isNotNull() | F.col("record_count").isNotNull()).alias("__any"))
    issue = (
        F.when(~F.col("__any"), F.lit(None).cast("string"))
        .when(~whole, "incomplete")
        .when((F.col("__d") > 1) | (F.col("__c") > 1), "inconsistent")
        .when(F.lower("sha256") != sha256.lower(), "other_snapshot")
        .when(F.col("record_count") != n_records, "other_count")
    )
    return queries.join(F.broadcast(seen), F.lit(True)).select("query_id", issue.alias("issue")).where("issue is not null")


def family_members(records: DataFrame) -> DataFrame:
    """parent_id and members (itself and its children, ascending) of the table families of records (stable_id, retrieval_role, table_parent_stable_id)."""
    own = records.where(F.col("retrieval_role").isin("table_parent", "table_child")).select(F.col("table_parent_stable_id").alias("parent_id"), "stable_id", (F.col("retrieval_role") == "table_parent").alias("is_parent"))
    grouped = own.groupBy("parent_id").agg(F.array_sort(F.collect_set("stable_id")).alias("members"), F.max(F.col("is_parent") & (F.col("stable_id") == F.col("parent_id"))).alias("whole"))
    return grouped.where("whole").select("parent_id", "members")


def family_issues(judgments: DataFrame, families: DataFrame) -> DataFrame:
    """query_id, judged_id and issue of judgments (see normalised_judgments) with accepted children that their family does not have."""
    asked = judgments.where("match_kind = 'accepted_table_child'").groupBy("query_id", "judged_id").agg(F.array_sort(F.collect_set("satisfying_id")).alias("accepted"))
    both = asked.join(families, F.col("judged_id") == F.col("parent_id"), "left")
    issue = F.when(F.col("parent_id").isNull(), "not_a_table_parent").when(F.size(F.array_except("accepted", "members")) > 0, "children_of_another")
    return both.select("query_id", "judged_id", issue.alias("issue")).where("issue is not null")


def review_candidates(runs: DataFrame, judged: DataFrame, depth: int = 10) -> DataFrame:
    """query_id, doc_id, best_rank, modes and place of the hits that no one judged, over several runs (mode, query_id, rank, doc_id).

    The best rank in any mode comes first, then the id.
    """
    own = runs.where(F.col("rank") <= depth).join(judged.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    seen = own.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best_rank"), F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"))
    return seen.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("best_rank", "doc_id")))


def redacted(details: DataFrame, ids: list[str], texts: list[str]) -> DataFrame:
    """``details`` with digests in place of ids and texts (null stays null)."""
    named = {c: F.sha2(F.col(c).cast("string"), 256) for c in [*ids, *texts]}
    return details.select(*[F.col(c) for c in details.columns if c not in named], *[v.alias(f"{c}_sha256") for c, v in named.items()])
