"""Structured Streaming over event files and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A file stream of event Parquet files."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; state older than ``late`` is dropped."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return own.select(F.col("window.start").alias("began"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    own = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return own.select("user_id", F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "n")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def stage_fold(events: DataFrame) -> DataFrame:
    """Running fold of each type: count, sum, least, greatest and latest value (update mode)."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"))


#: Job states and where they may go.
TRANSITIONS = [("queued", "running"), ("queued", "cancelled"), ("running", "succeeded"), ("running", "failed"), ("running", "cancelling"), ("cancelling", "cancelled"), ("failed", "queued")]


def illegal_steps(events: DataFrame, transitions: list[tuple[str, str]] = TRANSITIONS) -> DataFrame:
    """(job_id, sequence, before, after) of the steps that break the state machine; keeps one state a job."""
    from collections.abc import Iterator

    import pandas as pd

    legal = set(transitions)

    def step(key, parts: Iterator[pd.DataFrame], state):
        before = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(parts)).sort_values("sequence").itertuples():
            if before is not None and (before, row.status) not in legal:
                out.append((key[0], row.sequence, before, row.status))
            before = row.status
        state.update((before,))
        yield pd.DataFrame(out, columns=["job_id", "sequence", "before", "after"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string, sequence long, before string, after string", "status string", "append", "NoTimeout")


def merge_index(target: str):
    """A foreachBatch function: the newest hash of each id is merged into the Parquet table ``target``, by versions."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("id").agg(F.max_by("hash", "version").alias("hash"))
        try:
            held = spark.read.parquet(f"{target}/v{batch_id - 1}")
            newest = newest.unionByName(held.join(newest, "id", "left_anti"))
        except Exception as e:  # the first batch has no version before it
            if batch_id:
                raise e
        newest.write.mode("overwrite").parquet(f"{target}/v{batch_id}")

    return merge
