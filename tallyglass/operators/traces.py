"""Span tables: validation, dedupe, directory, summaries, trees, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.model import sampled

DEFAULT_LIMIT, MOST = 50, 1000


def valid_span(s: Column) -> Column:
    ok = (s["trace_id"] != "") & (s["span_id"] != "") & (s["name"] != "") & (s["end"] >= s["start"])
    return F.coalesce(ok, F.lit(False))


def duration_ms(start: Column, end: Column) -> Column:
    return (end - start) / F.lit(1e6)


def dedupe(spans: DataFrame) -> DataFrame:
    """The first written row of each (trace, span)."""
    order = Window.partitionBy("trace_id", "span_id").orderBy("epoch", "arrival")
    return spans.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def directory(spans: DataFrame, mint: int | None = None, maxt: int | None = None) -> DataFrame:
    """Bounds and span count of each trace that overlaps the window.

    Each source is bounded by itself first; only sources that overlap the window count.
    """
    # The first written of each span by an aggregate over what is needed: it combines before the exchange, attributes stay out.
    first = spans.groupBy("trace_id", "span_id").agg(F.min(F.struct("epoch", "arrival", "start", "end")).alias("s")).select("trace_id", "s.*")
    per = first.groupBy("epoch", "trace_id").agg(F.min("start").alias("min_start"), F.max("end").alias("max_end"), F.count(F.lit(1)).alias("spans"))
    if mint is not None:
        per = per.filter(F.col("max_end") >= mint)
    if maxt is not None:
        per = per.filter(F.col("min_start") <= maxt)
    return per.groupBy("trace_id").agg(F.min("min_start").alias("min_start"), F.max("max_end").alias("max_end"), F.max("spans").alias("spans"))


def newest(found: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    limit = limit if 0 < limit <= MOST else DEFAULT_LIMIT
    return found.orderBy(F.desc("min_start"), "trace_id").limit(limit)


def fetch(spans: DataFrame, trace_id: str) -> DataFrame:
    return dedupe(spans.filter(F.col("trace_id") == trace_id)).orderBy("start", "epoch", "arrival")


def roots(rows: DataFrame) -> DataFrame:
    """Of deduped spans, the root of each trace for summaries, with the trace's number of `spans`.

    It is the earliest span without a known parent, else the earliest. A span that names
    itself as parent has a known parent here.
    """
    known = rows.select(F.col("trace_id").alias("__t"), F.col("span_id").alias("__p"))
    joined = rows.join(known, (F.col("trace_id") == F.col("__t")) & (F.col("parent_id") == F.col("__p")), "left")
    first = F.coalesce(F.col("parent_id") == "", F.lit(True)) | F.col("__p").isNull()
    order = Window.partitionBy("trace_id").orderBy(F.when(first, 0).otherwise(1), "start", "epoch", "arrival")
    numbered = joined.withColumn("__n", F.row_number().over(order)).withColumn("spans", F.count(F.lit(1)).over(Window.partitionBy("trace_id")))
    return numbered.filter("__n = 1").drop("__n", "__t", "__p")


def summaries(spans: DataFrame, mint: int | None = None, maxt: int | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest traces with the name and attributes of their roots. Spans are fetched after the limit."""
    top = newest(directory(spans, mint, maxt), limit)
    chosen = spans.join(F.broadcast(top.select("trace_id")), "trace_id", "left_semi")  # at most MOST rows
    root = roots(dedupe(chosen)).select("trace_id", F.col("name").alias("root"), "attrs", "spans")
    return top.drop("spans").join(root, "trace_id").select(
        "trace_id", "root", F.col("min_start").alias("start"), F.col("max_end").alias("end"), duration_ms(F.col("min_start"), F.col("max_end")).alias("duration_ms"), "spans", "attrs"
    )


def tree(spans: DataFrame) -> DataFrame:
    """Waterfall rows: trace_id, span_id, parent_id, root_id, depth, path, duration_ms.

    Orphans and self-parented spans are roots; spans on a parent cycle, and below one, do
    not appear. `path` sorts siblings by start and arrival. Spans point to ancestors and
    jump along their pointers, so the rounds grow with the logarithm of the depth. A
    round that brings no span to its root ends it: what is left hangs on cycles.
    """
    from ..sources.shared import discard, staged

    rows = staged(dedupe(spans).select("trace_id", "span_id", "parent_id", "name", "start", "end", "epoch", "arrival"), "spans")
    known = rows.select(F.col("trace_id").alias("__t"), F.col("span_id").alias("__p"))
    has = rows.join(known, (F.col("trace_id") == F.col("__t")) & (F.col("parent_id") == F.col("__p")) & (F.col("parent_id") != F.col("span_id")), "left")
    root = F.col("__p").isNull()
    step = F.array(F.struct("start", "epoch", "arrival", "span_id"))
    ends = staged(
        has.select("trace_id", "span_id", F.when(root, F.col("span_id")).otherwise(F.col("parent_id")).alias("up"), F.when(root, 0).otherwise(1).alias("depth"), step.alias("path"), root.alias("done")), "pointers"
    )
    found, todo = [ends], ends.filter("not done")
    done = ends.filter("done")
    while True:
        state = done.unionByName(todo)
        at = state.select(F.col("trace_id").alias("__t"), F.col("span_id").alias("__s"), F.col("up").alias("__up"), F.col("depth").alias("__depth"), F.col("path").alias("__path"), F.col("done").alias("__done"))
        moved = staged(
            todo.join(at, (F.col("trace_id") == F.col("__t")) & (F.col("up") == F.col("__s")))
            .select("trace_id", "span_id", F.col("__up").alias("up"), (F.col("depth") + F.col("__depth")).alias("depth"), F.concat("__path", "path").alias("path"), F.col("__done").alias("done")),
            "pointers",
        )
        home = moved.filter("done")
        if home.isEmpty():
            discard(moved)
            break
        done, todo = done.unionByName(home), moved.filter("not done")
        found.append(moved)
    out = rows.join(done.drop("done").withColumnRenamed("up", "root_id"), ["trace_id", "span_id"])
    return out.withColumn("duration_ms", duration_ms(F.col("start"), F.col("end")))


def scoreboard(spans: DataFrame) -> DataFrame:
    """Traces and spans of each source."""
    first = spans.groupBy("epoch", "trace_id").agg(F.countDistinct("span_id").alias("n"))
    return first.groupBy("epoch").agg(F.count(F.lit(1)).alias("traces"), F.sum("n").alias("spans"))


def sample(spans: DataFrame, ratio: float) -> DataFrame:
    return spans.filter(sampled(F.col("trace_id"), ratio))


def retain(spans: DataFrame, cutoff: int) -> DataFrame:
    """Drop whole sources that end before the cutoff (0 and less: keep all)."""
    if cutoff <= 0:
        return spans
    live = spans.groupBy("epoch").agg(F.max("end").alias("__last")).filter(F.col("__last") >= cutoff)
    return spans.join(live, "epoch", "left_semi")


def waterfall_offsets(rows: DataFrame) -> DataFrame:
    """Left edge and width (per cent) of each span's bar within its trace."""
    whole = Window.partitionBy("trace_id")
    t0, total = F.min("start").over(whole), F.greatest(F.lit(1), F.max("end").over(whole) - F.min("start").over(whole))
    return rows.withColumn("left_pct", (F.col("start") - t0) / total * 100).withColumn("width_pct", F.greatest((F.col("end") - F.col("start")) / total * 100, F.lit(0.4)))
