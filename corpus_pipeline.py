"""The training-data pipeline: five stages over ``documents``, each a call of one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs.  The last stage adds the piece ids and keeps the text as decoded
from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontam, kn_quality, piece_codec, shingle_dedup, toxicity
from corpusmill.llm.common import removed, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of an expected severity below 0.5.

    Null and empty texts stay, as do all if the labels fit no model; repeated rows each stand; columns of any name are kept.
    """
    return toxicity.civil_documents(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose perplexity lies within their language's limit.

    Null and empty texts stay, as do all without trusted text; repeated rows each stand; columns of any name are kept.
    """
    return kn_quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked at a five-word similarity of 0.8 or more, the one with the least doc_id.

    Null and empty texts are one group; a null doc_id comes after all others; of repeated rows one stays; columns of any name are kept.
    """
    return shingle_dedup.without_near_copies(docs)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of benchmark items; those of which over half is such passages go.

    Null and empty texts stay as they are; repeated rows each stand; columns of any name are kept, and n_chars follows the text.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, how many these are, and the text as decoded from them.

    A null text has no ids and becomes the empty text; repeated rows each stand; columns named ids or n_tokens are replaced.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "n_tokens", "decoded")])
    coded = piece_codec.encode_decode(kept, public_tokenizers.path("piece_bpe_32k.model"), keep_memo=False)
    return coded.withColumn("n_tokens", F.size("ids").cast("long")).withColumnRenamed("decoded", "text")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmarks),
    ("sentencepiece", encode),
]

#: Trained models, fingerprint trees and tokenizers are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of ``documents``; what the stages before it wrote is deleted once it has been used."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        docs = spark.read.parquet(path)
        if last:
            removed(spark, last)
        last = path
    return docs
