"""A training-data pipeline over `documents`: toxicity, near duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and is written as Parquet before the
next reads it. All but the last return the columns of documents as they are; the last returns the shard of every row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import tidemark
from tidemark.llm.common import shared_dir, table
from tidemark.llm.decontamination import drop_contaminated
from tidemark.llm.jaccard_join import keep_first_of_groups
from tidemark.llm.mixing import sample_mixture
from tidemark.llm.sharding import shard_by_curve
from tidemark.llm.toxicity import drop_toxic

cloudpickle.register_pickle_by_value(tidemark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go; it learns from the labels of those that are there."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, by five-word shingles and a similarity of 0.8 or more: that of the least doc_id."""
    return keep_first_of_groups(docs, 5, 80, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark passage stands go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled with the probabilities that bring sources, languages and topics to their targets."""
    return sample_mixture(docs, bounded=True)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and slot in the order of the Hilbert curve."""
    return shard_by_curve(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Dictionaries, verified alignments and sketches have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
