"""Ingest batches: JSON lines of {spans, metrics}; validation and fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.model import BATCH
from ..operators.traces import valid_span

MAX_BYTES = 8 << 20


def read_batches(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of a landing folder with the parsed batch; malformed lines stay, with a null batch."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.format("text").load(path)
    source = F.struct(F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.select(source.alias("source"), F.col("value").alias("raw"), F.from_json("value", BATCH, {"mode": "PERMISSIVE"}).alias("batch"), F.from_json("value", "map<string,string>").alias("any"))


def accepted(batches: DataFrame) -> Column:
    """Whether a batch is well formed, small enough, and all of its records are valid."""
    spans = F.coalesce(F.col("batch.spans"), F.array().cast(batches.schema["batch"].dataType["spans"].dataType))
    points = F.coalesce(F.col("batch.metrics"), F.array().cast(batches.schema["batch"].dataType["metrics"].dataType))
    named = lambda m: F.coalesce(m["name"] != "", F.lit(False))
    ok = F.col("any").isNotNull() & (F.octet_length("raw") <= MAX_BYTES) & F.forall(spans, valid_span) & F.forall(points, named)
    return F.coalesce(ok, F.lit(False))


def fan_out(batches: DataFrame, epoch: int) -> tuple[DataFrame, DataFrame]:
    """Samples and spans of accepted batches, stamped with epoch and arrival order.

    Files count as arrived by modification time, then by name; lines in their order. Line
    numbers come from the splits of files, one row each, whatever the lines. `batches`
    must give the same rows each time it is read (persist a micro-batch).
    """
    numbered = batches.withColumn("seq", F.monotonically_increasing_id())
    splits = numbered.groupBy("source").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = numbered.join(F.broadcast(splits), "source").filter(accepted(batches)).withColumn("batch_no", F.col("offset") + F.col("seq") - F.col("first"))
    metrics = rows.select("batch_no", F.posexplode("batch.metrics").alias("pos", "m"))
    spans = rows.select("batch_no", F.posexplode("batch.spans").alias("pos", "s"))
    stamp = [F.lit(epoch).cast("long").alias("epoch"), (F.col("batch_no") * MAX_BYTES + F.col("pos")).alias("arrival")]
    samples = metrics.select("m.name", F.coalesce("m.labels", F.create_map().cast("map<string,string>")).alias("labels"), F.col("m.timestamp").alias("t"), F.col("m.value").alias("v"), *stamp)
    return samples, spans.select("s.*", *stamp)
