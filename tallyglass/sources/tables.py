"""The driver's tables seen as samples, spans and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with `t`, the whole milliseconds of ts."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long"))


def _samples(rows: DataFrame, name: str, labels, value) -> DataFrame:
    return rows.select(F.lit(name).alias("name"), labels.alias("labels"), "t", value.cast("double").alias("v"), F.pmod("event_id", F.lit(3)).alias("epoch"), F.col("event_id").alias("arrival"))


def _labels(users: int):
    user = F.pmod("user_id", F.lit(users)).cast("string")
    return F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("u"), user)


def gauge(spark: SparkSession, sf_dir: str, users: int = 10) -> DataFrame:
    return _samples(events(spark, sf_dir), "events_value", _labels(users), F.col("value"))


def running_sum(value: Column, over: WindowSpec) -> Column:
    """The sum of doubles as decimals, which are exact: equal sums are equal, and no order shows in them.

    Sums of floats fall by their last bits where nothing falls, which a counter takes for
    a new start. Decimals hold values below 1e9 to 18 places; others, NaN and infinities are added as floats.
    """
    fits = F.abs(value) < 1e9
    exact = F.sum(F.when(fits, value).cast("decimal(28,18)")).over(over).cast("double")
    other = F.sum(F.when(~fits, value)).over(over)
    return F.coalesce(exact + other, exact, other)


def counter(spark: SparkSession, sf_dir: str, users: int = 10, daily: bool = True) -> DataFrame:
    """Running sums of value by event type and user group; `daily` starts them anew each day."""
    rows = events(spark, sf_dir).withColumn("u", F.pmod("user_id", F.lit(users))).withColumn("day", F.floor(F.col("t") / 86_400_000))
    w = Window.partitionBy("event_type", "u", *(["day"] if daily else [])).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _samples(rows.withColumn("total", running_sum(F.col("value"), w)), "events_total", _labels(users), F.col("total"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a trace: the order its root, every line a child (of the line before it, if odd).

    Line numbers repeat, so spans do, and lines whose parent is missing are orphans.
    Times are days in ns; a line ends at its ship date or, if that is earlier, at once.
    """
    ns = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("trace_id"), F.lit("0").alias("span_id"), F.lit("").alias("parent_id"), F.lit("order").alias("name"),
        ns("o_orderdate").alias("start"), (ns("o_orderdate") + 86_400_000_000_000).alias("end"),
        F.create_map(F.lit("tenant"), F.pmod("o_custkey", F.lit(7)).cast("string")).alias("attrs"), F.pmod("o_orderkey", F.lit(3)).alias("epoch"), F.lit(0).cast("long").alias("arrival"),
    )
    n = F.col("l_linenumber")
    order = F.xxhash64("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").cast("string").alias("trace_id"), n.cast("string").alias("span_id"),
        F.when(n % 2 == 1, F.lit("0")).otherwise((n - 1).cast("string")).alias("parent_id"), F.concat(F.lit("line"), F.col("l_returnflag")).alias("name"),
        ns("l_shipdate").alias("start"), (ns("l_shipdate") + F.col("l_quantity").cast("long") * 3_600_000_000_000).alias("end"),
        F.create_map(F.lit("part"), F.col("l_partkey").cast("string")).alias("attrs"), F.pmod("l_partkey", F.lit(3)).alias("epoch"),
        (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("arrival"), order.alias("tie"),
    )
    return orders.unionByName(lines.drop("tie"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and its messages in order of turns."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda x: F.struct(x["role"], x["content"])).alias("messages"))
