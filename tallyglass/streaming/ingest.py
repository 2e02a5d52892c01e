"""Structured Streaming ingest: landing folder -> validated, admitted, append-only tables.

A micro-batch is one epoch. The checkpoint stands in for a write-ahead log: after a
crash the unfinished micro-batch runs again under the same epoch, and replaces what it
had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.storage import admit
from ..operators.traces import sample
from ..sources.batches import accepted, fan_out, read_batches


def ingest(spark: SparkSession, landing: str, out: str, checkpoint: str, max_series: int = 10_000, keep_traces: float = 1.0, interval: str | None = None) -> StreamingQuery:
    """Start the stream. Tables: out/metrics, out/spans (by epoch), out/rejected, out/dropped (counts)."""

    def write(df: DataFrame, name: str, epoch: int) -> None:
        df.drop("epoch").write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")

    def one(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            samples, spans = fan_out(batch, epoch)
            judged = admit(samples, max_series)
            write(judged.filter("status = 'kept'").drop("status", "series_key").sortWithinPartitions("name", "t"), "metrics", epoch)
            write(sample(spans, keep_traces), "spans", epoch)
            write(batch.filter(~accepted(batch)).select("raw"), "rejected", epoch)
            write(judged.filter("status <> 'kept'").groupBy("status").agg(F.count(F.lit(1)).alias("n")), "dropped", epoch)
        finally:
            batch.unpersist()

    stream = read_batches(spark, landing, streaming=True).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=interval) if interval else stream.trigger(availableNow=True)).start()


def read_metrics(spark: SparkSession, out: str) -> DataFrame:
    schema = "name string, labels map<string,string>, t bigint, v double, arrival bigint, epoch bigint"
    return spark.read.schema(schema).parquet(f"{out}/metrics")


def read_spans(spark: SparkSession, out: str) -> DataFrame:
    schema = "trace_id string, span_id string, parent_id string, name string, start bigint, end bigint, attrs map<string,string>, arrival bigint, epoch bigint"
    return spark.read.schema(schema).parquet(f"{out}/spans")


def newest_only(samples: DataFrame) -> DataFrame:
    """Streaming form of the order rule: per series, samples not newer than the newest seen are dropped.

    `samples` is a stream of (series_key, t, v, arrival); the state is one number a series.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def keep(key: tuple, frames, state: GroupState):
        newest = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("arrival")
        kept = []
        for i, t in enumerate(rows["t"]):
            if newest is None or t > newest:
                kept.append(i)
                newest = int(t)
        if newest is not None:
            state.update((newest,))
        yield rows.iloc[kept][["series_key", "t", "v", "arrival"]]

    return samples.groupBy("series_key").applyInPandasWithState(keep, "series_key string, t bigint, v double, arrival bigint", "newest bigint", "append", GroupStateTimeout.NoTimeout)
