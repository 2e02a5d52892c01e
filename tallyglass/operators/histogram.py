"""Log-linear histograms: exact below 128, then 64 buckets an octave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(v: Column) -> Column:
    v = F.greatest(v, F.lit(0)).cast("long")
    e = F.length(F.bin(v)) - 7
    low = (F.floor(v / F.pow(F.lit(2.0), e)).cast("long")).bitwiseAND(F.lit(63))
    return F.when(v < 128, v).otherwise(128 + (e - 1) * 64 + low).cast("long")


def midpoint(idx: Column) -> Column:
    e = F.floor((idx - 128) / 64)
    sub = F.pmod(idx - 128, F.lit(64)) + 64
    two = F.pow(F.lit(2.0), e).cast("long")
    return F.when(idx < 128, idx).otherwise(sub * 2 * two + two).cast("long")


def histogram(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return values.groupBy(*(by or []), bucket(F.col(column)).alias("idx")).agg(F.count(F.lit(1)).alias("n"), F.max(column).cast("long").alias("top"))


def quantiles(hist: DataFrame, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """Bucket midpoints at quantiles, with count, mean of midpoints and exact maximum."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    rows = hist.withColumn("cum", F.sum("n").over(w)).withColumn("total", F.sum("n").over(whole)).withColumn("mid", midpoint(F.col("idx")))
    rank = lambda q: F.greatest(F.lit(1), F.floor(F.lit(min(1.0, q if q > 0 else 1e-9)) * F.col("total") + 0.5))
    at = [F.min(F.when(F.col("cum") >= rank(q), F.col("mid"))).alias(f"q{q:g}".replace(".", "_")) for q in qs]
    return rows.groupBy(*by).agg(*at, F.max("total").alias("count"), F.floor(F.sum(F.col("mid") * F.col("n")) / F.max("total")).alias("mean"), F.max("top").alias("max"))
