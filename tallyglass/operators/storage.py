"""Admission, compaction, retention and counts of a sample table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.model import series_key
from .metrics import first_written


SHARDS = 64


def keyed(samples: DataFrame) -> DataFrame:
    return samples.withColumn("series_key", series_key(F.col("labels"), F.col("name")))


def admit(samples: DataFrame, max_series: int = 10_000) -> DataFrame:
    """All samples with `status`: kept, series_rejected (cap of new series an epoch) or ood_dropped (not newer).

    The cap comes first. Series are ranked by their first arrival over one row per
    series and epoch: within SHARDS parts first, so that the ranking of an epoch reads
    `max_series` rows of each part at most. `max_series` 0: no cap. Samples of one
    arrival come by time, then by value.
    """
    rows = keyed(samples)
    if max_series > 0:
        first = rows.groupBy("epoch", "series_key").agg(F.min("arrival").alias("first")).withColumn("shard", F.pmod(F.xxhash64("series_key"), F.lit(SHARDS)))
        for within in (["epoch", "shard"], ["epoch"]):
            rank = F.row_number().over(Window.partitionBy(*within).orderBy("first", "series_key"))
            first = first.withColumn("rank", rank).filter(F.col("rank") <= max_series).drop("rank")
        known = first.select("epoch", "series_key", F.lit(True).alias("known"))
        rows = rows.join(known, ["epoch", "series_key"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    else:
        rows = rows.withColumn("known", F.lit(True))
    before = Window.partitionBy("epoch", "series_key").orderBy("arrival", "t", "v").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max("t").over(before)
    late = newest.isNotNull() & (F.col("t") <= newest)
    status = F.when(~F.col("known"), "series_rejected").when(late, "ood_dropped").otherwise("kept")
    return rows.withColumn("status", status).drop("known")


def compact(samples: DataFrame, retain_after: int = 0) -> DataFrame:
    """One sample per (series, t), the oldest source's, without those before `retain_after` (0: all)."""
    rows = samples.filter(F.col("t") >= retain_after) if retain_after else samples
    return first_written(keyed(rows))


def scoreboard(samples: DataFrame) -> DataFrame:
    return keyed(samples).groupBy("epoch").agg(F.countDistinct("series_key").alias("series"), F.count(F.lit(1)).alias("samples"))


def write_segment(samples: DataFrame, path: str, epoch: int) -> None:
    """Append one flush. Sorting within files lets Parquet skip row groups by series and time."""
    rows = keyed(samples).withColumn("epoch", F.lit(epoch).cast("long"))
    rows.sortWithinPartitions("name", "series_key", "t").drop("series_key").write.mode("append").parquet(path)
