"""From raw documents to a tokenised training mix, in stages that each write Parquet and read it back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetmeter.llm import ftrl, mixing, pieces, simhash, substrings
from fleetmeter.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ftrl.accepted(docs, ftrl.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints (three-word shingles) link at two or fewer bits the one with the least id."""
    return simhash.without_near_duplicates(docs, shingle=3, distance=2)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that occur more than once."""
    return substrings.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the mix asks for."""
    return mixing.mixed(docs, mixing.plan(docs, weights=(5, 2, 1), most=3))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document of the mix."""
    return pieces.segmentations(docs, samples=2)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mix", mix), ("segment", segment),
]

#: SQL can't say the stages: a trained model, 64-bit hashes and sampled lattices decide.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
