"""Documents to training data: judged, deduplicated, mixed and encoded.

Each stage takes the rows its predecessor kept.  All but the last return the columns of documents; mixing returns a
row for each time a document is taken, and encoding adds what the ids are.  Every stage needs a unique doc_id up to
mixing and takes empty tables, null and empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from packetloom.llm.queries import PATTERN, RANKS
from packetloom.llm.tables import documents, materialize


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each component of similar documents."""
    return jaccard_join.keep_one_per_component(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the source targets ask for."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the number of tokens, the digest of the ids and whether they decode to the text.

    A task encodes and decodes with one Python worker, and nothing is written in between.
    A column that has one of the new names gives way.
    """
    kept = tuple(c for c in docs.columns if c not in ("n_tokens", "ids", "decoded", "ids_sha256", "round_trip"))
    return bpe.round_trips(docs, RANKS, PATTERN, keep=kept)


STAGES = [("quality", judge), ("exact_dedup", drop_exact), ("jaccard_join", drop_near), ("mix", mix),
          ("bpe", tokenize)]

# Similar sets, the classifier and the merges are not in reach of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read back before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
