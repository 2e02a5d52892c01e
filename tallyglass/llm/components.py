"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each component of the edges (a, b).

    Labels spread to neighbours and then jump along themselves, so the rounds grow with
    the logarithm of a component's diameter at best. Each round is written, and thus
    a lost executor costs one round. Nodes without an edge do not appear.
    """
    spark = edges.sparkSession
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        spread = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a").agg(F.min("comp").alias("seen")).withColumnRenamed("a", "node")
        )
        new = labels.join(spread, "node").select("node", "comp", F.least("comp", "seen").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("comp").alias("root"))
        step = staged(new.join(up, "next").select("node", "comp", F.least("next", "root").alias("next")), "labels")
        moved = step.filter("next <> comp").limit(1).count()
        labels = step.select("node", F.col("next").alias("comp"))
        release(spark)
        if not moved:
            return labels
