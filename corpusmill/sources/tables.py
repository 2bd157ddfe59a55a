"""Parquet tables of a corpus directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """An inline table: ``rows`` as SQL VALUES tuples, which DuckDB reads alike."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys if its scan has fewer partitions than the cluster has cores twice; larger inputs stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < 2 * cores else df
