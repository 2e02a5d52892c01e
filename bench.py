"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.plans import catalog
from tallyglass.plans.engine import Engine

HEADLINE = ("rate_by_type", "fn_quantile_over_time", "spend_by_group", "fold_sum_by", "lookback", "hit_rate", "trace_directory", "trace_summaries", "histogram_quantiles", "admission")


STEP, SPAN, SERIES = 5_000, 30 * 60_000, 200
END = 1_704_067_200_000
#: Queries of the published shape: 200 series, 30 minutes every 5 s (72,000 samples of each metric).
SHAPES = {
    "shape_rate": ("sum by (tenant) (rate(tokens_total[1m]))", 15 * 60_000, 15_000),
    "shape_quantile": ("quantile_over_time(0.99, wait_ms[1m])", 15 * 60_000, 15_000),
    "shape_increase": ('increase(tokens_total{tenant="t07"}[5m])', 0, 15_000),
}


def shape(spark: SparkSession, series: int) -> DataFrame:
    """A counter and a gauge for each of `series` series, up to END."""
    points = SPAN // STEP
    n, k = F.floor(F.col("id") / points), F.col("id") % points
    labels = F.create_map(F.lit("tenant"), F.format_string("t%02d", n % 20), F.lit("series"), n.cast("string"))
    rows = spark.range(series * points).select(labels.alias("labels"), (F.lit(END - SPAN) + k * STEP).alias("t"), (k * (n % 7 + 1)).cast("double").alias("c"), (F.pmod(F.xxhash64("id"), F.lit(1000))).cast("double").alias("g"), F.lit(0).cast("long").alias("epoch"), F.col("id").alias("arrival"))
    each = F.explode(F.array(F.struct(F.lit("tokens_total").alias("name"), F.col("c").alias("v")), F.struct(F.lit("wait_ms").alias("name"), F.col("g").alias("v"))))
    return rows.select("labels", "t", "epoch", "arrival", each.alias("m")).select("m.name", "labels", "t", "m.v", "epoch", "arrival")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, took = catalog.queries(), {}
    found[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    rates = {}
    for tag, series in (("", SERIES), ("_x100", 100 * SERIES)):
        held = shape(spark, series).cache()
        rows = held.count() // 2
        for name, (query, back, step) in SHAPES.items():
            began = time.time()
            Engine(held).range(query, END - back, END, step).write.format("noop").mode("overwrite").save()
            took[name + tag] = round(time.time() - began, 3)
            rates[name + tag] = round(rows / max(took[name + tag], 1e-3))
        held.unpersist()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took[q] for q in HEADLINE), 3), "unit": "sec", "queries": took, "samples_per_second": rates, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
