"""Named queries over the driver's tables, each with its SQL.

The SQL joins steps with samples, which is another formulation than the engine's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gorilla
from ..functions.language import FOLDS, FUNCTIONS, Matcher
from ..functions.model import fnv32, legend, series_key
from ..operators import histogram, metrics, storage, traces, traffic
from ..sources import tables
from .engine import Engine

FLAGSHIP = "rate_by_type"
DAY, HOUR = 86_400_000, 3_600_000
START, END = 1_704_067_200_000, 1_704_067_200_000 + 30 * DAY  # January 2024
Query = Callable[[SparkSession, str], DataFrame]


def _round(df: DataFrame) -> DataFrame:
    """series, t and v: values rounded, as sums of floats depend on their order."""
    return df.select(F.col("series_key").alias("series"), "t", F.round("v", 6).alias("v"))


def _range(query: str, source: str, start: int = START, end: int = END, step: int = 6 * HOUR, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        samples = getattr(tables, source)(spark, sf_dir)
        return _round(Engine(samples, **kw).range(query, start, end, step))

    return run


def _spans(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(tables.spans(s, d))


def _ordered_gauge(s: SparkSession, d: str) -> DataFrame:
    """The gauge with arrival shuffled by a hash, so that late samples occur."""
    return tables.gauge(s, d).withColumn("arrival", F.pmod(F.col("arrival") * 7919, F.lit(1_000_003)))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    c = tables.chats(s, d)
    text = F.transform("messages", lambda m: m["content"])
    return c.select("conv_id", traffic.prompt_tokens(text).alias("prompt_tokens"), traffic.estimated_tokens(text, F.when(F.col("conv_id") % 2 == 0, 50)).alias("estimate"))


def _keys(s: SparkSession, d: str) -> DataFrame:
    return tables.chats(s, d).select("conv_id", traffic.cache_key(F.lit("acme"), F.lit("m1"), F.lit(None).cast("int"), F.col("messages")).alias("cache_key"))


def _requests(s: SparkSession, d: str) -> DataFrame:
    e = tables.events(s, d)
    return e.select(F.pmod("user_id", F.lit(5)).cast("string").alias("tenant"), "t", F.col("event_id").alias("arrival"), F.floor(F.abs("value")).cast("double").alias("estimate"), F.floor(F.abs("value") / 2).cast("double").alias("used"), F.col("user_id").cast("string").alias("key"), F.floor(F.abs("value")).cast("long").alias("tokens"), F.concat(F.lit("c"), F.pmod("user_id", F.lit(4)).cast("string")).alias("cache"), "event_type", (F.pmod("event_id", F.lit(3)) != 0).alias("ok"))


def _status(s: SparkSession, d: str) -> DataFrame:
    rows = _requests(s, d).select("tenant", "t", "arrival", "estimate", "used")
    outcomes = traffic.run_budget(rows, 600)
    charged = outcomes.filter("outcome = 'admitted'").join(rows, ["tenant", "t", "arrival"]).groupBy("tenant").agg(F.sum("used").cast("long").alias("charged"))
    return traffic.tenant_status(outcomes, charged, 600)


def _small(s: SparkSession, d: str) -> DataFrame:
    e = tables.events(s, d)
    labels = F.create_map(F.lit("u"), F.pmod("user_id", F.lit(10)).cast("string"), F.lit("event_type"), F.col("event_type"))
    n = F.col("event_id")
    return e.select(
        "event_id", traffic.counter_key(F.lit("n"), labels).alias("counter_key"), traffic.nice_ceil(F.col("value")).alias("ceiling"),
        traffic.cacheable(F.when(n % 3 == 0, F.lit(0.0)).when(n % 3 == 1, F.lit(0.7))).alias("cacheable"),
        traffic.finish_reason(F.when(n % 2 == 0, F.col("event_type")).when(n % 3 == 0, "length")).alias("finish"),
        traffic.saved_tokens(F.when(n % 2 == 0, n), F.col("event_type")).alias("saved"),
    )


def _reservations(s: SparkSession, d: str) -> DataFrame:
    """A reservation for each event, and its settlement up to some minutes later, for some twice or never."""
    r = _requests(s, d).select("tenant", F.col("arrival").alias("request"), "t", "estimate", "used")
    asks = r.select("tenant", "request", F.lit("reserve").alias("kind"), "t", (F.col("request") * 4).alias("arrival"), F.col("estimate").alias("tokens"))
    ends = r.select("tenant", "request", F.lit("settle").alias("kind"), (F.col("t") + F.pmod("request", F.lit(5)) * 60_000).alias("t"), (F.col("request") * 4 + 1).alias("arrival"), F.col("used").alias("tokens"))
    again = ends.filter("request % 7 = 0").withColumn("arrival", F.col("arrival") + 1)
    return asks.unionByName(ends.filter("request % 11 <> 0")).unionByName(again)


def _failover(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    good = F.create_map(F.lit("a"), n % 3 != 0, F.lit("b"), n % 5 != 0)
    rows = tables.events(s, d).select(
        F.pmod("user_id", F.lit(10)).cast("string").alias("pool"), "t", n.alias("arrival"), good.alias("good"),
        F.when(n % 6 == 0, "a").alias("probe"), (n % 13 == 0).alias("cancelled"),
    )
    return traffic.run_router(rows, ("a", "b"), 2, HOUR)


def queries() -> dict[str, Query]:
    w6, q = f"[{6}h]", {}
    q[FLAGSHIP] = _range(f"sum by (event_type) (rate(events_total{w6}))", "counter", step=HOUR)
    for f in FUNCTIONS:
        arg = "0.95, " if f.startswith("quantile") else ""
        name = "counter" if f in ("rate", "increase") else "gauge"
        metric = "events_total" if name == "counter" else "events_value"
        q[f"fn_{f}"] = _range(f"{f}({arg}{metric}[12h])", name)
    for f in FOLDS:
        q[f"fold_{f}_by"] = _range(f"{f} by (event_type) (events_value)", "gauge", lookback_ms=12 * HOUR)
    q["fold_sum_bare"] = _range("sum(events_value)", "gauge", lookback_ms=12 * HOUR)
    q["fold_missing_label"] = _range("count by (nothing, u) (events_value)", "gauge", lookback_ms=12 * HOUR)
    q["fold_nested"] = _range("max(sum by (event_type) (events_value))", "gauge", lookback_ms=12 * HOUR)
    q["lookback"] = _range("events_value", "gauge", lookback_ms=6 * HOUR)
    q["instant"] = lambda s, d: _round(Engine(tables.gauge(s, d), 48 * HOUR).instant('events_value{u="3"}', START + 10 * DAY))
    q["match_equal_unequal"] = _range('sum by (event_type) (count_over_time(events_value{u!="3",event_type!=""}[12h]))', "gauge")
    q["match_absent_empty"] = lambda s, d: _round(Engine(_zoned(s, d), 12 * HOUR).range('count by (u) (events_value{zone=""})', START, END, 6 * HOUR))
    q["select_raw"] = lambda s, d: _round(metrics.select(tables.gauge(s, d), "events_value", (Matcher("u", "3"),), START, START + 5 * DAY))
    q["spend_by_group"] = _range("sum by (u) (increase(events_total[1h]))", "counter", step=HOUR)
    q["hit_rate"] = lambda s, d: metrics.hit_rate(Engine(_cache_counter(s, d)).range("sum by (cache) (rate(requests_total[6h]))", START, END, 6 * HOUR)).select("t", F.round("v", 6).alias("v"))
    q["admission"] = lambda s, d: storage.admit(_ordered_gauge(s, d), 12).groupBy("epoch", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("sum_t"))
    q["compaction"] = lambda s, d: _round(storage.compact(tables.gauge(s, d, 1).withColumn("t", F.floor(F.col("t") / DAY) * DAY), START + 3 * DAY))
    q["scoreboard"] = lambda s, d: storage.scoreboard(tables.gauge(s, d))
    q["series_legend"] = lambda s, d: tables.gauge(s, d).select(series_key(F.col("labels"), F.col("name")).alias("series"), legend(F.col("labels")).alias("legend")).distinct()
    q["trace_directory"] = _spans(lambda t: traces.directory(t, 0))
    q["trace_newest"] = _spans(lambda t: traces.newest(traces.directory(t), 50))
    q["trace_summaries"] = _spans(lambda t: traces.summaries(t, limit=100).select("trace_id", "root", "start", "end", "duration_ms", "spans", F.element_at("attrs", "tenant").alias("tenant")))
    q["trace_tree"] = _spans(lambda t: traces.tree(t).select("trace_id", "span_id", "root_id", "depth", "duration_ms"))
    q["trace_sampled"] = _spans(lambda t: traces.sample(t.select("trace_id").distinct(), 0.25))
    q["trace_hash"] = _spans(lambda t: t.select("trace_id").distinct().select("trace_id", fnv32(F.col("trace_id")).alias("h")))
    q["trace_retained"] = _spans(lambda t: traces.retain(t.withColumn("epoch", F.year(F.timestamp_micros(F.floor(F.col("start") / 1000)))), 883_612_800_000_000_000).groupBy("epoch").agg(F.count(F.lit(1)).alias("n")))
    q["waterfall"] = _spans(lambda t: traces.waterfall_offsets(traces.dedupe(t)).select("trace_id", "span_id", F.round("left_pct", 6).alias("left_pct"), F.round("width_pct", 6).alias("width_pct")))
    q["token_estimates"] = _tokens
    q["cache_keys"] = _keys
    q["cumulative_counter"] = lambda s, d: tables.counter(s, d, daily=False).select(F.col("arrival").alias("event_id"), F.round("v", 4).alias("total"))
    q["cost"] = lambda s, d: tables.events(s, d).groupBy("event_type").agg(F.round(F.sum(traffic.cost_usd(F.floor(F.abs("value")), 400.0)), 6).alias("cost"))
    q["histogram"] = lambda s, d: histogram.histogram(tables.events(s, d).withColumn("x", F.floor(F.abs("value") * 1000).cast("long")), "x").select("idx", "n")
    q["histogram_quantiles"] = lambda s, d: histogram.quantiles(histogram.histogram(tables.events(s, d).withColumn("x", F.floor(F.abs("value") * 1000).cast("long")), "x", ["event_type"]), [0.5, 0.9, 0.99], ["event_type"])
    q["time_bits"] = lambda s, d: storage.keyed(tables.gauge(s, d)).select("series_key", "t", gorilla.time_bits().alias("bits")).groupBy(F.col("series_key").alias("series")).agg(F.sum("bits").cast("long").alias("bits"))
    q["compression_report"] = lambda s, d: gorilla.report(storage.keyed(tables.gauge(s, d)))
    q["budget"] = lambda s, d: traffic.run_budget(_requests(s, d).select("tenant", "t", "arrival", "estimate", "used"), 600).withColumn("available", F.round("available", 6))
    q["tenant_status"] = _status
    q["trace_scoreboard"] = _spans(traces.scoreboard)
    q["trace_window"] = _spans(lambda t: traces.directory(t, 788_918_400_000_000_000, 820_454_400_000_000_000))
    q["query_range"] = lambda s, d: _round(Engine(tables.gauge(s, d)).query_range("avg by (event_type) (avg_over_time(events_value[15m]))", START + DAY + 12_345, START + 2 * DAY, "15m"))
    q["small_functions"] = _small
    q["cache_counters"] = lambda s, d: traffic.cache_counters(q["response_cache"](s, d))
    q["reservations"] = lambda s, d: traffic.run_reservations(_reservations(s, d), 600).withColumn("available", F.round("available", 6))
    q["failover"] = _failover
    q["compression_total"] = lambda s, d: gorilla.total(q["compression_report"](s, d))
    q["response_cache"] = lambda s, d: traffic.run_cache(_requests(s, d).select("cache", "key", "t", "arrival", "tokens"), 64, 6 * HOUR)
    q["breaker"] = lambda s, d: traffic.run_breaker(_requests(s, d).select(F.col("event_type").alias("provider"), "t", "arrival", "ok"), 2, HOUR)
    return q


def _zoned(s: SparkSession, d: str) -> DataFrame:
    """The gauge, whose group 1 has an empty label `zone`, group 2 a full one, and the others none."""
    zone = F.when(F.col("labels")["u"] == "1", "").when(F.col("labels")["u"] == "2", "a")
    put = F.map_concat("labels", F.create_map(F.lit("zone"), zone))
    return tables.gauge(s, d).withColumn("labels", F.when(zone.isNull(), F.col("labels")).otherwise(put))


def _cache_counter(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = tables.events(s, d).withColumn("cache", F.when(F.col("event_id") % 3 == 0, "hit").otherwise("miss"))
    n = F.row_number().over(Window.partitionBy("cache").orderBy("event_id"))
    return tables._samples(rows.withColumn("n", n), "requests_total", F.create_map(F.lit("cache"), F.col("cache")), F.col("n"))


# The SQL. Every piece is DuckDB text over the same tables.
_EV = "SELECT *, epoch_us(ts) // 1000 AS t, CAST(((user_id % 10) + 10) % 10 AS VARCHAR) AS u FROM events"
_GAUGE = f"WITH e AS ({_EV}), d AS (SELECT event_type, u, t, value AS v, row_number() OVER (PARTITION BY event_type, u, t ORDER BY event_id % 3, event_id) AS n FROM e), s AS (SELECT event_type, u, t, v FROM d WHERE n = 1)"
_COUNTER = f"WITH e AS ({_EV}), c AS (SELECT event_type, u, t, event_id, sum(value) OVER (PARTITION BY event_type, u, t // {DAY} ORDER BY event_id) AS v FROM e), d AS (SELECT *, row_number() OVER (PARTITION BY event_type, u, t ORDER BY event_id % 3, event_id) AS n FROM c), s AS (SELECT event_type, u, t, v FROM d WHERE n = 1)"
_KEY = "concat('{event_type=\"', event_type, '\",u=\"', u, '\"}')"


def _grid(step: int, end: int = END) -> str:
    return f"g AS (SELECT unnest(range({START}, {end} + 1, {step})) AS g)"


def _window_sql(function: str, r: int, step: int, end: int = END, where: str = "true") -> str:
    """(event_type, u, g, v) of a range function as CTE `f`."""
    if function in ("rate", "increase"):
        pairs = f"j AS (SELECT event_type, u, g, t, v, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM g JOIN s ON t > g - {r} AND t <= g WINDOW w AS (PARTITION BY event_type, u, g ORDER BY t))"
        grow = "sum(CASE WHEN v < pv THEN v ELSE v - pv END)"
        value = grow if function == "increase" else f"{grow} / ((max(t) - min(pt)) / 1000.0)"
        return f"{_COUNTER}, {_grid(step, end)}, {pairs}, f AS (SELECT event_type, u, g, {value} AS v FROM j WHERE pv IS NOT NULL GROUP BY ALL)"
    value = {"quantile_over_time": "quantile_cont(v, 0.95)", "count_over_time": "CAST(count(*) AS DOUBLE)"}.get(function, f"{function.split('_')[0]}(v)")
    return f"{_GAUGE}, {_grid(step, end)}, f AS (SELECT event_type, u, g, {value} AS v FROM g JOIN s ON t > g - {r} AND t <= g WHERE {where} GROUP BY event_type, u, g)"


def _back_sql(back: int, step: int = 6 * HOUR) -> str:
    return f"{_GAUGE}, {_grid(step)}, f AS (SELECT event_type, u, g, arg_max(v, t) AS v FROM g JOIN s ON t >= g - {back} AND t <= g GROUP BY event_type, u, g)"


_DONE = "g AS t, round(v, 6) AS v"
_BY_TYPE = "concat('{event_type=\"', event_type, '\"}') AS series"
_SPANS = """WITH raw AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS trace_id, '0' AS span_id, '' AS parent_id, 'order' AS name, epoch_us(o_orderdate) * 1000 AS start, epoch_us(o_orderdate) * 1000 + 86400000000000 AS "end",
           CAST(o_custkey % 7 AS VARCHAR) AS tenant, o_orderkey % 3 AS epoch, 0 AS arrival FROM orders
    UNION ALL
    SELECT CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CASE WHEN l_linenumber % 2 = 1 THEN '0' ELSE CAST(l_linenumber - 1 AS VARCHAR) END, concat('line', l_returnflag),
           epoch_us(l_shipdate) * 1000, epoch_us(l_shipdate) * 1000 + CAST(l_quantity AS BIGINT) * 3600000000000, NULL, l_partkey % 3, l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) FROM lineitem),
  spans AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY epoch, arrival) = 1)"""
_DIR = "per AS (SELECT epoch, trace_id, min(start) AS a, max(\"end\") AS b, count(*) AS n FROM spans GROUP BY ALL), dir AS (SELECT trace_id, min(a) AS min_start, max(b) AS max_end, max(n) AS spans FROM per GROUP BY ALL)"
_FNV = "list_reduce(list_prepend(CAST(2216829733 AS BIGINT), list_transform(range(1, len(trace_id) + 1), lambda i: CAST(ord(trace_id[i]) AS BIGINT))), lambda h, b: (xor(h, b) * 435) & 4294967295)"
_X = "WITH e AS (SELECT event_type, CAST(floor(abs(value) * 1000) AS BIGINT) AS x FROM events), i AS (SELECT *, CASE WHEN x < 128 THEN x ELSE 128 + (len(bin(x)) - 8) * 64 + ((x >> CAST(len(bin(x)) - 7 AS BIGINT)) & 63) END AS idx FROM e)"


def oracle_sql() -> dict[str, str]:
    h = 6 * HOUR
    sql = {FLAGSHIP: f"{_window_sql('rate', 6 * HOUR, HOUR)} SELECT {_BY_TYPE}, g AS t, round(sum(v), 6) AS v FROM f GROUP BY event_type, g"}
    for fn in FUNCTIONS:
        sql[f"fn_{fn}"] = f"{_window_sql(fn, 12 * HOUR, h)} SELECT {_KEY} AS series, {_DONE} FROM f"
    back = _back_sql(12 * HOUR)
    for fold in FOLDS:
        value = "CAST(count(*) AS DOUBLE)" if fold == "count" else f"{fold}(v)"
        sql[f"fold_{fold}_by"] = f"{back} SELECT {_BY_TYPE}, g AS t, round({value}, 6) AS v FROM f GROUP BY event_type, g"
    sql["fold_sum_bare"] = f"{back} SELECT '{{}}' AS series, g AS t, round(sum(v), 6) AS v FROM f GROUP BY g"
    sql["fold_missing_label"] = f"{back} SELECT concat('{{u=\"', u, '\"}}') AS series, g AS t, CAST(count(*) AS DOUBLE) AS v FROM f GROUP BY u, g"
    sql["fold_nested"] = f"{back} SELECT '{{}}' AS series, g AS t, round(max(v), 6) AS v FROM (SELECT event_type, g, sum(v) AS v FROM f GROUP BY ALL) GROUP BY g"
    sql["lookback"] = f"{_back_sql(6 * HOUR)} SELECT concat('events_value', {_KEY}) AS series, {_DONE} FROM f"
    at = START + 10 * DAY
    sql["instant"] = f"{_GAUGE} SELECT concat('events_value', {_KEY}) AS series, CAST({at} AS BIGINT) AS t, round(arg_max(v, t), 6) AS v FROM s WHERE u = '3' AND t >= {at - 48 * HOUR} AND t <= {at} GROUP BY event_type, u"
    sql["match_equal_unequal"] = f"{_window_sql('count_over_time', 12 * HOUR, h, where="u <> '3'")} SELECT {_BY_TYPE}, g AS t, round(sum(v), 6) AS v FROM f GROUP BY event_type, g"
    sql["match_absent_empty"] = f"{back} SELECT concat('{{u=\"', u, '\"}}') AS series, g AS t, CAST(count(*) AS DOUBLE) AS v FROM f WHERE u = '1' GROUP BY u, g"
    sql["select_raw"] = f"{_GAUGE} SELECT concat('events_value', {_KEY}) AS series, t, round(v, 6) AS v FROM s WHERE u = '3' AND t BETWEEN {START} AND {START + 5 * DAY}"
    sql["spend_by_group"] = f"{_window_sql('increase', HOUR, HOUR)} SELECT concat('{{u=\"', u, '\"}}') AS series, g AS t, round(sum(v), 6) AS v FROM f GROUP BY u, g"
    sql["hit_rate"] = f"""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS t, CASE WHEN event_id % 3 = 0 THEN 'hit' ELSE 'miss' END AS c FROM events),
        n AS (SELECT c, t, row_number() OVER (PARTITION BY c ORDER BY event_id) AS v, row_number() OVER (PARTITION BY c, t ORDER BY event_id % 3, event_id) AS k FROM e), s AS (SELECT c, t, v FROM n WHERE k = 1), {_grid(h)},
        r AS (SELECT c, g, (max(v) - min(v)) / ((max(t) - min(t)) / 1000.0) AS v FROM g JOIN s ON t > g - {h} AND t <= g GROUP BY ALL HAVING count(*) > 1),
        p AS (SELECT g, coalesce(max(v) FILTER (c = 'hit'), 0) AS a, coalesce(max(v) FILTER (c = 'miss'), 0) AS b FROM r GROUP BY g)
        SELECT g AS t, round(100 * a / (a + b), 6) AS v FROM p WHERE a + b > 0"""
    sql["admission"] = f"""WITH e AS (SELECT event_type, u, t, event_id % 3 AS epoch, (event_id * 7919) % 1000003 AS arrival FROM ({_EV})),
        f AS (SELECT epoch, event_type, u, row_number() OVER (PARTITION BY epoch ORDER BY min(arrival), concat('events_value', {_KEY})) AS k FROM e GROUP BY epoch, event_type, u),
        m AS (SELECT e.*, k, max(t) OVER (PARTITION BY e.epoch, event_type, u ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM e JOIN f USING (epoch, event_type, u)),
        st AS (SELECT epoch, t, CASE WHEN k > 12 THEN 'series_rejected' WHEN newest >= t THEN 'ood_dropped' ELSE 'kept' END AS status FROM m)
        SELECT epoch, status, count(*) AS n, CAST(sum(t) AS BIGINT) AS sum_t FROM st GROUP BY ALL"""
    sql["compaction"] = f"""WITH e AS (SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS t, value, event_id FROM events)
        SELECT concat('events_value{{event_type="', event_type, '",u="0"}}') AS series, t, round(value, 6) AS v FROM e WHERE t >= {START + 3 * DAY} QUALIFY row_number() OVER (PARTITION BY event_type, t ORDER BY event_id % 3, event_id) = 1"""
    sql["scoreboard"] = f"SELECT event_id % 3 AS epoch, count(DISTINCT (event_type, u)) AS series, count(*) AS samples FROM ({_EV}) GROUP BY 1"
    sql["series_legend"] = f"SELECT DISTINCT concat('events_value', {_KEY}) AS series, concat(event_type, ' · ', u) AS legend FROM ({_EV})"
    sql["trace_directory"] = f"{_SPANS}, {_DIR} SELECT * FROM dir WHERE max_end >= 0"
    sql["trace_newest"] = f"{_SPANS}, {_DIR} SELECT * FROM dir ORDER BY min_start DESC, trace_id LIMIT 50"
    sql["trace_summaries"] = f"""{_SPANS}, {_DIR}, top AS (SELECT * FROM dir ORDER BY min_start DESC, trace_id LIMIT 100),
        k AS (SELECT s.*, NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_id) AS first FROM spans s),
        r AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY first DESC, start, epoch, arrival) = 1),
        c AS (SELECT trace_id, count(*) AS n FROM spans GROUP BY 1)
        SELECT top.trace_id, r.name AS root, min_start AS start, max_end AS "end", (max_end - min_start) / 1e6 AS duration_ms, n AS spans, r.tenant FROM top JOIN r USING (trace_id) JOIN c USING (trace_id)"""
    sql["trace_tree"] = _SPANS.replace("WITH raw", "WITH RECURSIVE raw") + """, tree AS (
        SELECT trace_id, span_id, span_id AS root_id, 0 AS depth, start, "end" FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_id AND p.span_id <> s.span_id)
        UNION ALL SELECT c.trace_id, c.span_id, t.root_id, t.depth + 1, c.start, c."end" FROM spans c JOIN tree t ON c.trace_id = t.trace_id AND c.parent_id = t.span_id WHERE c.span_id <> c.parent_id)
        SELECT trace_id, span_id, root_id, depth, ("end" - start) / 1e6 AS duration_ms FROM tree"""
    sql["trace_hash"] = f"{_SPANS} SELECT trace_id, {_FNV} AS h FROM (SELECT DISTINCT trace_id FROM raw)"
    sql["trace_sampled"] = f"{_SPANS} SELECT trace_id FROM (SELECT DISTINCT trace_id FROM raw) WHERE {_FNV} < 1073741824"
    sql["trace_retained"] = f"""{_SPANS}, y AS (SELECT CAST(year(make_timestamp(start // 1000)) AS INTEGER) AS epoch, "end" FROM raw) SELECT epoch, count(*) AS n FROM y GROUP BY 1 HAVING max("end") >= 883612800000000000"""
    sql["waterfall"] = f"""{_SPANS}, b AS (SELECT *, min(start) OVER w AS t0, greatest(1, max("end") OVER w - min(start) OVER w) AS total FROM spans WINDOW w AS (PARTITION BY trace_id))
        SELECT trace_id, span_id, round((start - t0) / total * 100, 6) AS left_pct, round(greatest(("end" - start) / total * 100, 0.4), 6) AS width_pct FROM b"""
    sql["token_estimates"] = "SELECT conv_id, CAST(sum(strlen(coalesce(text, '')) // 4 + 4) AS BIGINT) AS prompt_tokens, CAST(sum(strlen(coalesce(text, '')) // 4 + 4) AS BIGINT) + CASE WHEN conv_id % 2 = 0 THEN 50 ELSE 256 END AS estimate FROM conversations GROUP BY conv_id"
    field = lambda x: f"printf('%08X', strlen({x})) || hex({x})"
    head = "00000004" + b"acme".hex() + "00000002" + b"m1".hex() + "00000001" + b"0".hex() + "00000008" + b"\0default".hex()
    sql["cache_keys"] = f"SELECT conv_id, sha256(unhex('{head}' || string_agg({field('role')} || {field("coalesce(text, '')")}, '' ORDER BY turn))) AS cache_key FROM conversations GROUP BY conv_id"
    steps = """WITH RECURSIVE r AS (SELECT CAST(((user_id % 5) + 5) % 5 AS VARCHAR) AS tenant, event_type AS provider, epoch_us(ts) // 1000 AS t, event_id AS arrival, floor(abs(value)) AS want, floor(abs(value) / 2) AS used, event_id % 3 <> 0 AS ok FROM events)"""
    sql["budget"] = f"""{steps}, e AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY t, arrival) AS k FROM r), s AS (
        SELECT tenant, CAST(0 AS BIGINT) AS k, min(t) AS t, CAST(0 AS BIGINT) AS arrival, '' AS outcome, CAST(0 AS BIGINT) AS retry_after, CAST(600 AS DOUBLE) AS available FROM e GROUP BY tenant
        UNION ALL SELECT tenant, k, t, arrival, CASE WHEN want > 600 THEN 'over_capacity' WHEN want > a THEN 'exhausted' ELSE 'admitted' END,
            CASE WHEN want > 600 OR want <= a THEN 0 ELSE CAST(greatest(1, ceil((want - a) / 10.0)) AS BIGINT) END, CASE WHEN want > 600 OR want > a THEN a ELSE least(600, a - want + want - used) END
        FROM (SELECT e.*, least(600, s.available + (e.t - s.t) / 1000.0 * 10.0) AS a FROM s JOIN e ON e.tenant = s.tenant AND e.k = s.k + 1))
        SELECT tenant, t, arrival, outcome, retry_after, round(available, 6) AS available FROM s WHERE k > 0"""
    sql["tenant_status"] = sql["budget"].split("SELECT tenant, t, arrival, outcome, retry_after, round")[0].replace("AS retry_after, CAST(600 AS DOUBLE) AS available", "AS retry_after, CAST(600 AS DOUBLE) AS available, CAST(0 AS DOUBLE) AS spent").replace(
        "ELSE least(600, a - want + want - used) END", "ELSE least(600, a - want + want - used) END, used"
    ) + """SELECT tenant, CAST(floor(arg_max(available, k)) AS BIGINT) AS available, 600 AS capacity, count(*) FILTER (outcome = 'admitted') AS admitted, count(*) FILTER (outcome <> 'admitted') AS rejected,
        CAST(sum(spent) FILTER (outcome = 'admitted') AS BIGINT) AS charged FROM s WHERE k > 0 GROUP BY tenant"""
    sql["trace_scoreboard"] = f"{_SPANS}, p AS (SELECT epoch, trace_id, count(DISTINCT span_id) AS n FROM raw GROUP BY ALL) SELECT epoch, count(*) AS traces, CAST(sum(n) AS BIGINT) AS spans FROM p GROUP BY 1"
    sql["trace_window"] = f"""{_SPANS}, per AS (SELECT epoch, trace_id, min(start) AS a, max("end") AS b, count(*) AS n FROM spans GROUP BY ALL HAVING max("end") >= 788918400000000000 AND min(start) <= 820454400000000000)
        SELECT trace_id, min(a) AS min_start, max(b) AS max_end, max(n) AS spans FROM per GROUP BY 1"""
    sql["query_range"] = f"""{_GAUGE}, g AS (SELECT unnest(range({START + DAY}, {START + 2 * DAY} + 1, 900000)) AS g), f AS (SELECT event_type, u, g, avg(v) AS v FROM g JOIN s ON t > g - 900000 AND t <= g GROUP BY ALL)
        SELECT {_BY_TYPE}, g AS t, round(avg(v), 6) AS v FROM f GROUP BY event_type, g"""
    sql["small_functions"] = """WITH e AS (SELECT *, pow(10, floor(log10(CASE WHEN value > 0 THEN value ELSE 1 END))) AS p FROM events)
        SELECT event_id, 'n' || chr(0) || 'event_type=' || event_type || chr(0) || 'u=' || CAST(((user_id % 10) + 10) % 10 AS VARCHAR) AS counter_key,
            CASE WHEN value > 0 THEN CASE WHEN value <= p THEN p WHEN value <= 2 * p THEN 2 * p WHEN value <= 5 * p THEN 5 * p ELSE 10 * p END ELSE 1.0 END AS ceiling, event_id % 3 = 0 AS cacheable,
            CASE WHEN event_id % 2 <> 0 AND event_id % 3 = 0 THEN 'length' ELSE 'stop' END AS finish, CASE WHEN event_id % 2 = 0 THEN event_id ELSE strlen(event_type) // 4 END AS saved FROM e"""
    sql["breaker"] = f"""{steps}, e AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY t, arrival) AS k FROM r), s AS (
        SELECT DISTINCT provider, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS arrival, false AS allowed, 'closed' AS state, 0 AS failures, CAST(0 AS BIGINT) AS since FROM e
        UNION ALL SELECT provider, k, t, arrival, pass, CASE WHEN NOT pass THEN was WHEN ok THEN 'closed' WHEN was <> 'closed' OR failures + 1 >= 2 THEN 'open' ELSE 'closed' END,
            CASE WHEN NOT pass THEN failures WHEN ok OR was <> 'closed' OR failures + 1 >= 2 THEN 0 ELSE failures + 1 END, CASE WHEN pass AND (was <> 'closed' OR (NOT ok AND failures + 1 >= 2)) THEN t ELSE since END
        FROM (SELECT e.*, s.state AS was, s.failures, s.since, s.state = 'closed' OR e.t - s.since >= {HOUR} AS pass FROM s JOIN e ON e.provider = s.provider AND e.k = s.k + 1))
        SELECT provider, t, arrival, allowed, state FROM s WHERE k > 0"""
    sql["cumulative_counter"] = "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type, ((user_id % 10) + 10) % 10 ORDER BY event_id), 4) AS total FROM events"
    sql["cost"] = "SELECT event_type, round(sum(floor(abs(value)) * 400.0 / 1e6), 6) AS cost FROM events GROUP BY 1"
    sql["histogram"] = f"{_X} SELECT idx, count(*) AS n FROM i GROUP BY 1"
    sql["histogram_quantiles"] = f"""{_X}, m AS (SELECT *, CASE WHEN idx < 128 THEN idx ELSE (((idx - 128) % 64) + 64) * 2 * (1 << CAST((idx - 128) // 64 AS BIGINT)) + (1 << CAST((idx - 128) // 64 AS BIGINT)) END AS mid FROM i),
        o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY idx) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM m)
        SELECT event_type, min(mid) FILTER (k >= greatest(1, floor(0.5 * n + 0.5))) AS q0_5, min(mid) FILTER (k >= greatest(1, floor(0.9 * n + 0.5))) AS q0_9, min(mid) FILTER (k >= greatest(1, floor(0.99 * n + 0.5))) AS q0_99,
               count(*) AS count, CAST(sum(mid) // count(*) AS BIGINT) AS mean, max(x) AS max FROM o GROUP BY event_type"""
    sql["time_bits"] = f"""WITH e AS ({_EV}), a AS (SELECT event_type, u, t - lag(t) OVER w AS d, t - lag(t) OVER w - coalesce(lag(t) OVER w - lag(t, 2) OVER w, 0) AS dd FROM e WINDOW w AS (PARTITION BY event_type, u ORDER BY t))
        SELECT concat('events_value', {_KEY}) AS series, CAST(sum(CASE WHEN d IS NULL THEN 64 WHEN dd = 0 THEN 1 WHEN dd BETWEEN -63 AND 64 THEN 9 WHEN dd BETWEEN -255 AND 256 THEN 12 WHEN dd BETWEEN -2047 AND 2048 THEN 16 ELSE 68 END) AS BIGINT) AS bits FROM a GROUP BY event_type, u"""
    return sql
