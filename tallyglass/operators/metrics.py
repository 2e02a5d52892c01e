"""Operators on samples: select, lookback, range windows, folds.

Samples are long: name, labels, t (ms), v, epoch, arrival. A result (matrix) has
series_key, name, labels, t, v with one row per series and step that has a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import FOLDS, QUANTILE, Matcher, QueryError
from ..functions.model import series_key


def matches(m: Matcher) -> Column:
    """`=` needs the label, also for an empty value; a missing label differs from any other value than ''."""
    have = F.element_at("labels", m.label) if m.label != "__name__" else F.col("name")
    return have.eqNullSafe(F.lit(m.value)) if m.equal else F.coalesce(have, F.lit("")) != m.value


def select(samples: DataFrame, name: str | None, matchers: tuple[Matcher, ...], mint: int, maxt: int) -> DataFrame:
    """Samples of matching series with mint <= t <= maxt, one per (series, t): the first written.

    The name and time bounds reach the Parquet scan. The window that removes duplicates
    partitions by series, as everything behind it does, so it adds no shuffle.
    """
    rows = samples.filter(F.col("t").between(mint, maxt))
    if name is not None:
        rows = rows.filter(F.col("name") == name)
    rows = reduce(lambda d, m: d.filter(matches(m)), matchers, rows)
    rows = rows.withColumn("series_key", series_key(F.col("labels"), F.col("name")))
    return first_written(rows)


def first_written(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("series_key").orderBy("t", "epoch", "arrival")
    before = F.lag("t").over(order)
    return rows.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("__before") != F.col("t"))).drop("__before")


def _floor(x: Column, by: int) -> Column:
    return ((x - F.pmod(x, F.lit(by))) / by).cast("long")


def at_steps(rows: DataFrame, since: Column, until: Column, start: int, end: int, step: int) -> DataFrame:
    """Each row once for every step of the grid in [since, until], as column `step_t`."""
    lo = F.greatest(F.lit(0).cast("long"), -_floor(F.lit(start) - since, step))
    hi = _floor(F.least(until, F.lit(end)) - F.lit(start), step)
    return (
        rows.withColumn("__lo", lo).withColumn("__hi", hi).filter("__lo <= __hi")
        .withColumn("step_t", F.explode(F.sequence(F.col("__lo") * step + start, F.col("__hi") * step + start, F.lit(step).cast("long"))))
        .drop("__lo", "__hi")
    )


def lookback(rows: DataFrame, start: int, end: int, step: int, back: int) -> DataFrame:
    """At each step the newest sample of each series, not older than `back`."""
    order = Window.partitionBy("series_key").orderBy("t")
    until = F.least(F.col("t") + back, F.coalesce(F.lead("t").over(order) - 1, F.col("t") + back))
    rows = rows.withColumn("until", until)
    return at_steps(rows, F.col("t"), F.col("until"), start, end, step).select("series_key", "name", "labels", F.col("step_t").alias("t"), "v")


def range_window(rows: DataFrame, function: str, r: int, start: int, end: int, step: int, phi: float | None = None) -> DataFrame:
    """A function of the samples in (s - r, s] of each series, for every step s with a value."""
    if r <= 0:
        raise QueryError("the range must be positive")
    if function in ("rate", "increase"):
        order = Window.partitionBy("series_key").orderBy("t")
        rows = rows.withColumn("pt", F.lag("t").over(order)).withColumn("pv", F.lag("v").over(order)).filter("pt is not null")
        rows = rows.withColumn("d", F.when(F.col("v") < F.col("pv"), F.col("v")).otherwise(F.col("v") - F.col("pv")))
        # A growth counts where both of its samples are inside.
        spread = at_steps(rows, F.col("t"), F.col("pt") + (r - 1), start, end, step)
        value = F.sum("d") if function == "increase" else F.sum("d") / ((F.max("t") - F.min("pt")) / 1000)
    else:
        spread = at_steps(rows, F.col("t"), F.col("t") + (r - 1), start, end, step)
        if function == QUANTILE:
            if phi is None or not 0 <= phi <= 1:
                raise QueryError("the quantile must be between 0 and 1")
            value = F.percentile("v", F.lit(phi))
        else:
            value = {"avg": F.avg("v"), "sum": F.sum("v"), "min": F.min("v"), "max": F.max("v"), "count": F.count("v").cast("double")}[function.split("_")[0]]
    out = spread.groupBy("series_key", "step_t").agg(F.first("labels").alias("labels"), value.alias("v"))
    return out.select(series_key(F.col("labels")).alias("series_key"), F.lit(None).cast("string").alias("name"), "labels", F.col("step_t").alias("t"), "v")


def fold(matrix: DataFrame, how: str, by: tuple[str, ...]) -> DataFrame:
    """Fold the series present at each step; a series without a `by` label has its own group."""
    if how not in FOLDS:
        raise QueryError(f"unknown fold {how}")
    by = tuple(b for b in by if b != "__name__")
    value = {"sum": F.sum("v"), "avg": F.avg("v"), "min": F.min("v"), "max": F.max("v"), "count": F.count(F.lit(1)).cast("double")}[how]
    keys = [F.element_at("labels", b).alias(f"__by{i}") for i, b in enumerate(by)]
    out = matrix.groupBy(*keys, "t").agg(value.alias("v"))
    entries = F.array(*[F.struct(F.lit(b).alias("key"), F.col(f"__by{i}").alias("value")) for i, b in enumerate(by)])
    labels = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())) if by else F.create_map().cast("map<string,string>")
    return out.withColumn("labels", labels).select(series_key(F.col("labels")).alias("series_key"), F.lit(None).cast("string").alias("name"), "labels", "t", "v")


def to_result(matrix: DataFrame) -> DataFrame:
    """One row per series with its samples in order: the shape of a query answer."""
    return matrix.groupBy("series_key").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("samples")).orderBy("series_key")


def hit_rate(by_cache: DataFrame) -> DataFrame:
    """100 * hits / (hits + misses) at each step of `sum by (cache) (...)`; steps without either are absent."""
    of = lambda k: F.sum(F.when(F.element_at("labels", "cache") == k, F.col("v")).otherwise(0.0))
    both = by_cache.groupBy("t").agg(of("hit").alias("h"), of("miss").alias("m")).filter("h + m > 0")
    return both.select("t", (100 * F.col("h") / (F.col("h") + F.col("m"))).alias("v"))
