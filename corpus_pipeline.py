"""A corpus pipeline: toxicity, exact dedup, near dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of `documents`; the last adds `size` and `copies` to the documents it takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import settled, staged, table
from tallyglass.llm.decontaminate import drop_contaminated
from tallyglass.llm.exact_dedup import keep_first
from tallyglass.llm.mixing import mix
from tallyglass.llm.near_dedup import keep_one
from tallyglass.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies of each.

    Rows that repeat a doc_id share the larger of their numbers of copies.
    """
    largest = [F.max(c).alias(c) for c in ("size", "copies")]
    taken = settled(lambda: mix(docs).filter("copies > 0").groupBy(F.col("doc_id").alias("__id")).agg(*largest), "taken")
    return docs.drop("size", "copies").join(taken, docs["doc_id"].eqNullSafe(taken["__id"])).drop("__id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The toxicity classifier is no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
