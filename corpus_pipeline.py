"""From raw documents to a training mix, stage by stage.

Every stage takes what its predecessor kept, as a stored table, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import decontaminate, mixing, secret_scan, simhash, weak_labels
from tallyline.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go."""
    return weak_labels.accepted_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by fingerprints of three-word shingles at most three bits apart stays."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; the documents stay."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes any word, with their size and the words taken.

    A helper column whose name the documents have already gets underscores in front.
    """
    mixed = mixing.mix(docs, carry=True).where("taken > 0")
    names = []
    for name in ("size", "source_size", "target", "taken"):
        while name in docs.columns or name in names:
            name = f"_{name}"
        names.append(name)
    facts = [F.col(own).alias(name) for own, name in zip(("size", "source_size", "target", "taken"), names)]
    return mixed.select("doc.*", *facts)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: The stages learn models and link texts; SQL cannot express them, and the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
