"""Run logs and model calls: validation, folds, recovery, reports and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators.corpus import exact_percentiles

#: Statuses that end a run, and those that end a stage; fixed values.
RUN_ENDS, STAGE_ENDS = ["succeeded", "partial", "failed", "cancelled"], ["completed", "skipped", "failed", "cancelled"]
STATUSES = ["started", "completed", "skipped", "failed", "cancelled", "succeeded", "partial"]


def log_issues(events: DataFrame, tie: str = "stage") -> DataFrame:
    """run_id, sequence and issue of run logs (run_id, sequence, stage, status, parent_run_id) that break their rules.

    Sequences count from 1 without gaps; a run begins with its start, has one parent, ends at most once and last, and its own
    events are only that start and that end.  Events of one number are looked at in the order of ``tie``.
    """
    w = W.partitionBy("run_id").orderBy("sequence", tie)
    own = events.withColumn("__n", F.row_number().over(w)).withColumn("__more", F.lead("sequence").over(w)).withColumn("__parent", F.first("parent_run_id").over(w))
    run, ends = F.col("stage") == "run", F.col("status").isin(RUN_ENDS)
    issue = (
        F.when(F.col("sequence") != F.col("__n"), "sequence_gap")
        .when(~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), "unknown_status")
        .when((F.col("__n") == 1) & ~(run & (F.col("status") == "started")), "no_run_start")
        .when(~F.col("parent_run_id").eqNullSafe(F.col("__parent")), "parent_changed")
        .when(run & ends & F.col("__more").isNotNull(), "events_after_end")
        .when((F.col("__n") > 1) & run & ~ends, "run_status")
    )
    return own.select("run_id", "sequence", issue.alias("issue")).where("issue is not null")


def stage_summaries(events: DataFrame) -> DataFrame:
    """run_id, stage, counts of each status and the whole duration of run logs (with duration_ms); the run's own events aside."""
    own = events.where("stage <> 'run'")
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES]
    return own.groupBy("run_id", "stage").agg(*counts, F.round(F.sum("duration_ms"), 3).alias("duration_ms"))


def stage_metrics(events: DataFrame) -> DataFrame:
    """run_id, stage, metric and its fold over the events that end a stage.

    ``events``: run_id, sequence, stage, status, metric, number, flag (one of the two set).  Numbers give samples, total,
    least, most and latest; flags samples, trues, falses and latest; a metric of both kinds has ``mixed`` true.
    """
    own = events.where(F.col("status").isin(STAGE_ENDS) & (F.col("stage") != "run") & (F.col("number").isNotNull() | F.col("flag").isNotNull()))
    n = lambda c: F.count(F.when(c, 1))
    return own.groupBy("run_id", "stage", "metric").agg(
        F.count("*").alias("samples"), F.round(F.sum("number"), 3).alias("total"), F.round(F.min("number"), 3).alias("least"), F.round(F.max("number"), 3).alias("most"), F.round(F.max_by("number", F.when(F.col("number").isNotNull(), F.col("sequence"))), 3).alias("latest"),
        n(F.col("flag")).alias("trues"), n(~F.col("flag")).alias("falses"), F.max_by("flag", F.when(F.col("flag").isNotNull(), F.col("sequence"))).alias("latest_flag"), ((F.count("number") > 0) & (F.count("flag") > 0)).alias("mixed"),
    )


def recovery(events: DataFrame, status: str = "failed") -> DataFrame:
    """run_id, sequence, stage, status and source_event_count: the events that close runs which never ended.

    Every stage that was started and not ended is closed in the order of its names, then the run itself; the last event tells how
    many events there were and how many stages were closed.  A run that ended gets none.
    """
    ended = events.where((F.col("stage") == "run") & F.col("status").isin(RUN_ENDS)).select("run_id").distinct()
    open_runs = events.join(ended, "run_id", "left_anti")
    sizes = open_runs.groupBy("run_id").agg(F.count("*").alias("n"), F.max("sequence").alias("last"))
    balance = F.sum(F.when(F.col("status") == "started", 1).when(F.col("status").isin(STAGE_ENDS), -1).otherwise(0))
    stages = open_runs.where("stage <> 'run'").groupBy("run_id", "stage").agg(balance.alias("open")).where("open > 0").select("run_id", "stage")
    closed = stages.groupBy("run_id").agg(F.count("*").alias("closed"))
    placed = stages.withColumn("place", F.row_number().over(W.partitionBy("run_id").orderBy("stage"))).join(sizes, "run_id")
    stage_rows = placed.select("run_id", (F.col("last") + F.col("place")).alias("sequence"), "stage", F.lit(status).alias("status"), F.lit(None).cast("long").alias("source_event_count"), F.lit(None).cast("long").alias("active_stages_closed"))
    ends = sizes.join(closed, "run_id", "left").fillna(0, ["closed"])
    return stage_rows.unionByName(ends.select("run_id", (F.col("last") + F.col("closed") + 1).alias("sequence"), F.lit("run").alias("stage"), F.lit(status).alias("status"), F.col("n").alias("source_event_count"), F.col("closed").alias("active_stages_closed")))


def call_report(calls: DataFrame) -> DataFrame:
    """provider, calls, succeeded, retries, tokens in and out, cache hits, p50 and p95 of latency of model calls.

    ``calls``: provider, attempts, status, prompt_tokens, completion_tokens, cached, latency_ms.
    """
    n = lambda c: F.count(F.when(c, 1))
    sums = calls.groupBy("provider").agg(F.count("*").alias("calls"), n(F.col("status") == "succeeded").alias("succeeded"), F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), n(F.col("cached")).alias("cache_hits"))
    places = exact_percentiles(calls, "provider", "latency_ms", [0.5, 0.95]).select("provider", F.round("r0", 3).alias("p50"), F.round("r1", 3).alias("p95"))
    return sums.join(places, "provider", "left")


def coalesced(requests: DataFrame, key: Column, call: Column) -> DataFrame:
    """``requests`` with answer: ``call`` is evaluated once for each distinct key, however many requests have it."""
    keyed = requests.withColumn("__key", key)
    once = keyed.dropDuplicates(["__key"]).select("__key", call.alias("answer"))
    return keyed.join(once, "__key").drop("__key")


def usage_status(exact: Column, estimated: Column, unknown: Column) -> Column:
    """How sure a sum of token usage is: not_run, partial_unknown_usage, estimated or exact."""
    return F.when(exact + estimated + unknown == 0, "not_run").when(unknown > 0, "partial_unknown_usage").when(estimated > 0, "estimated").otherwise("exact")


def cost_projection(usage: DataFrame, rate_in: float | None, rate_out: float | None) -> DataFrame:
    """``usage`` (input_tokens, output_tokens, exact, estimated, unknown attempts) with status and usd; no rate or unknown usage gives null."""
    status = usage_status(F.col("exact"), F.col("estimated"), F.col("unknown"))
    usd = F.lit(None).cast("double") if rate_in is None or rate_out is None else F.round((F.col("input_tokens") * rate_in + F.col("output_tokens") * rate_out) / 1e6, 9)
    return usage.withColumn("status", status).withColumn("usd", F.when(F.col("status").isin("estimated", "exact"), usd))
