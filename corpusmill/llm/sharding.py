"""Sharding by jump consistent hashing: a key and the number of shards decide the shard, without a table of any ring.

The jump hash walks a key's own pseudo-random sequence to the last jump below the number of shards.  With one shard more, a
key stays or moves to the new shard, and 1/(n+1) of the keys move.  Keys of one value share a shard by that law, so equal ids
are as balanced as the ids are.

Slots number the rows of a shard without gaps by ascending key.  They are counted over ranges of shard and key (``ranges``),
so a shard lies in many tasks, and only two records a partition reach the driver.

Defined results: a null key is dealt as zero and stands before all others in its shard; equal keys are ordered by size and
CRC of their text, repeated rows each get a slot of their own; a null text has no bytes and the CRC of none; an empty table
gives an empty result; own columns are kept by ``sharded`` and ``write_shards`` unless they bear the names that these add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import ranges
from corpusmill.llm.common import crc32_sql

#: Multiplier of the hash's generator; fixed value.
STEP = 2862933555777941757


def jump(keys, shards: int):
    """The shards of an array of 64-bit keys."""
    import numpy as np

    if shards < 1:
        raise ValueError("one shard at least")
    state = np.asarray(keys, np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    reached = np.zeros(len(state), np.int64)
    while len(going):
        shard[going] = reached
        state[going] = state[going] * np.uint64(STEP) + np.uint64(1)
        draw = (state[going] >> np.uint64(33)).astype(np.float64) + 1
        reached = ((shard[going] + 1) * (2.0**31 / draw)).astype(np.int64)
        still = reached < shards
        going, reached = going[still], reached[still]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long ``key``; null counts as zero."""

    @F.pandas_udf("int")
    def run(keys):
        import pandas as pd

        return pd.Series(jump(keys.to_numpy(), shards))

    return run(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def sharded(rows: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """``rows`` with their shard in a column ``name``; no shuffle."""
    return rows.withColumn(name, shard_of(F.col(f"`{key}`"), shards))


def slotted(rows: DataFrame, shard: str, order: list[str], name: str = "slot") -> DataFrame:
    """``rows`` with their place within the shard, from 0 without gaps, in the given order."""
    own = ranges.dealt(rows, shard, order)
    edges = rows.sparkSession.sparkContext.broadcast(own.edges)

    def run(batches):
        import pyarrow as pa

        found = ranges.placed(batches, edges.value, shard)
        if found:
            yield from ranges.pieces(found.table.append_column(name, pa.array(found.place, pa.int64())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return own.rows.mapInArrow(run, f"{fields}, `{name}` long")


def write_shards(rows: DataFrame, key: str, shards: int, path: str, files: int = 1) -> None:
    """Writes Parquet folders shard=0, shard=1, ... below ``path``; each is dealt over ``files`` tasks by a hash of the row."""
    dealt = sharded(rows, key, shards)
    plain = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*plain), F.lit(files))
    dealt.repartition(shards * files, "shard", salt).write.partitionBy("shard").parquet(path)


def grow_shards(spark: SparkSession, path: str, key: str, shards: int, more: int, to: str) -> None:
    """Writes the rows of ``path`` (n shards) that move when there are ``more`` of them, below ``to``; the rest stay where they are."""
    held = spark.read.parquet(path)
    moved = held.withColumn("__to", shard_of(F.col(f"`{key}`"), shards + more)).where("__to <> shard")
    moved.drop("shard").withColumnRenamed("__to", "shard").write.partitionBy("shard").parquet(to)


def shard_digests(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more) of every document."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    measured = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + F.lit(8)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    both = measured.withColumns({"shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1)})
    placed = slotted(both, "shard", ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def oracle(shards: int = 24) -> str:
    """The same rows in DuckDB: the walk of the hash as a recursion in 128-bit integers, the CRC bit by bit."""
    walk = f"((s * {STEP} + 1) % 18446744073709551616)"
    to = f"(CAST(floor((b + 1) * (2147483648.0::DOUBLE / (({walk} // 8589934592) + 1)::DOUBLE)) AS BIGINT))"
    return f"""
WITH RECURSIVE data AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), measured AS (
  SELECT doc_id, octet_length(encode(t)) + 8 AS size, row_number() OVER () AS r,
    {crc32_sql("list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT)")} AS text_crc32
  FROM data
), walk AS (
  SELECT r, (CASE WHEN coalesce(doc_id, 0) < 0 THEN coalesce(doc_id, 0)::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END) AS s,
    -1::BIGINT AS was, 0::BIGINT AS b FROM measured
  UNION ALL
  SELECT r, {walk}, b, {to} FROM walk WHERE b < {shards + 1}
), found AS (
  SELECT r, max(b) FILTER (WHERE b < {shards}) AS shard, max(b) FILTER (WHERE b < {shards + 1}) AS grown_shard FROM walk GROUP BY r
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM measured JOIN found USING (r)"""
