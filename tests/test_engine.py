import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallyglass.functions import gorilla
from tallyglass.functions.language import QueryError
from tallyglass.functions.model import fnv32
from tallyglass.operators import storage, traces, traffic
from tallyglass.operators.traffic import Breaker, Budget, Cache, cache_key
from tallyglass.plans.engine import Engine
from tallyglass.sources import tables

SCHEMA = "name string, labels map<string,string>, t bigint, v double, epoch bigint, arrival bigint"


def samples(spark, *series):
    rows, n = [], 0
    for name, labels, points in series:
        for t, v in points:
            rows.append((name, labels, t, float(v), 0, n))
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


def values(df):
    return {(r.series_key, r.t): r.v for r in df.collect()}


#: (t, v) of a counter that starts anew twice, with uneven gaps.
COUNTER = [(300, 4), (1_700, 9), (2_900, 9), (4_100, 2), (7_600, 11), (8_000, 1), (9_900, 6)]


def inside(points, step, span):
    return [(t, v) for t, v in points if step - span < t <= step]


def grown(points):
    return sum(b - a if b >= a else b for (_, a), (_, b) in zip(points, points[1:], strict=False))


PLAIN = {
    "increase": grown, "rate": lambda p: grown(p) / ((p[-1][0] - p[0][0]) / 1000), "avg_over_time": lambda p: sum(v for _, v in p) / len(p),
    "sum_over_time": lambda p: sum(v for _, v in p), "min_over_time": lambda p: min(v for _, v in p), "max_over_time": lambda p: max(v for _, v in p), "count_over_time": len,
}


@pytest.mark.parametrize("function", PLAIN)
def test_range_functions(spark, function):
    c = samples(spark, ("c", {"k": "z"}, COUNTER))
    want = {}
    for step in range(0, 12_001, 750):
        p = inside(COUNTER, step, 3_000)
        if len(p) > (function in ("rate", "increase")):
            want['{k="z"}', step] = pytest.approx(PLAIN[function](p))
    assert values(Engine(c).range(f"{function}(c[3s])", 0, 12_000, 750)) == want


def test_quantile_interpolates(spark):
    c = samples(spark, ("c", {}, COUNTER))
    v = sorted(x for _, x in COUNTER)
    assert values(Engine(c).instant("quantile_over_time(0.25, c[1h])", 9_900)) == {("{}", 9_900): pytest.approx((v[1] + v[2]) / 2)}


def test_lookback(spark):
    m = samples(spark, ("g", {}, COUNTER))
    want = {}
    for step in range(0, 16_001, 900):
        p = [(t, v) for t, v in COUNTER if step - 2_500 <= t <= step]
        if p:
            want["g{}", step] = p[-1][1]
    assert values(Engine(m, 2_500).range("g", 0, 16_000, 900)) == want
    assert values(Engine(m, 2_500).instant("other", 900)) == {}


def test_fold_keeps_series_without_the_label(spark):
    m = samples(spark, ("g", {"zone": "n", "k": "1"}, [(3, 2)]), ("g", {"zone": "n", "k": "2"}, [(4, 5)]), ("g", {"k": "3"}, [(5, 11)]))
    assert values(Engine(m).instant("sum by (zone) (g)", 6)) == {('{zone="n"}', 6): 7, ("{}", 6): 11}


def test_errors(spark):
    m = samples(spark, ("m", {}, [(1, 1)]))
    for call in (lambda e: e.range("m", 0, 10, 0), lambda e: e.range("m", 10, 0, 1), lambda e: e.instant("quantile_over_time(2, m[1m])", 1), lambda e: e.query_range("m", 0, 10**12, "1ms")):
        with pytest.raises(QueryError):
            call(Engine(m))


def test_admission_and_compaction(spark):
    late = [(40, 1), (70, 2), (70, 3), (55, 4), (90, 5)]
    got = storage.admit(samples(spark, ("g", {}, late))).orderBy("arrival").collect()
    newest, want = -1, []
    for t, _ in late:
        want.append("kept" if t > newest else "ood_dropped")
        newest = max(newest, t)
    assert [r.status for r in got] == want
    many = samples(spark, *[("g", {"k": str(i)}, [(1, i), (2, i)]) for i in range(30)])
    kept = storage.admit(many, 7).filter("status = 'kept'").select("labels").collect()
    assert sorted(int(r.labels["k"]) for r in kept) == sorted([*range(7), *range(7)])
    rows = [("g", {}, 8, 3.5, 5, 0), ("g", {}, 8, 4.5, 4, 9), ("g", {}, 9, 1.0, 5, 1), ("g", {}, 2, 1.0, 5, 2)]
    assert sorted((r.t, r.v) for r in storage.compact(spark.createDataFrame(rows, SCHEMA), 5).collect()) == [(8, 4.5), (9, 1.0)]


SPANS = "trace_id string, span_id string, parent_id string, name string, start bigint, end bigint, attrs map<string,string>, epoch bigint, arrival bigint"


def test_trace_tree_and_hash(spark):
    parents = {"top": "", "left": "top", "right": "top", "leaf": "left", "own": "own", "stray": "nowhere", "ring1": "ring2", "ring2": "ring1", "hung": "ring1"}
    spans = spark.createDataFrame([("t", s, p, s, 10 + i, 50, {}, 0, i) for i, (s, p) in enumerate(parents.items())], SPANS)
    got = {r.span_id: (r.root_id, r.depth, [x.span_id for x in r.path]) for r in traces.tree(spans).collect()}
    assert got == {
        "top": ("top", 0, ["top"]), "left": ("top", 1, ["top", "left"]), "right": ("top", 1, ["top", "right"]), "leaf": ("top", 2, ["top", "left", "leaf"]),
        "own": ("own", 0, ["own"]), "stray": ("stray", 0, ["stray"]),
    }
    assert traces.roots(spans).first().span_id == "top"
    h = 0xCBF29CE484222325
    for byte in "höhe".encode():
        h = (h ^ byte) * 0x100000001B3 % 2**64
    assert spark.range(1).select(fnv32(F.lit("höhe"))).first()[0] == h % 2**32


def test_a_deep_trace_is_whole(spark):
    spans = spark.createDataFrame([("t", str(i), str(i - 1) if i else "", "s", i, i + 1, {}, 0, i) for i in range(130)], SPANS)
    got = traces.tree(spans).collect()
    assert sorted(r.depth for r in got) == list(range(130)) and all(len(r.path) == r.depth + 1 and r.root_id == "0" for r in got)


def test_state_machines():
    b = Budget(1_200)  # 20 a second
    assert b.reserve(1_150, 0) == ("admitted", 0) and b.reserve(100, 0) == ("exhausted", 3) and b.reserve(1_201, 0) == ("over_capacity", 0)
    assert b.reserve(100, 2_500) == ("admitted", 0)
    b.settle(1_150, 1_300, 2_500)
    assert b.available == -150 and b.reserve(1, 2_500) == ("exhausted", 8)
    c = Cache(3, 500)
    for k in "xyz":
        c.put(k, ord(k), 0)
    assert c.get("x", 10) == ord("x")
    c.put("w", 1, 20)
    assert c.get("y", 30) is None and c.get("x", 500) and c.get("x", 501) is None and c.get("w", 501) == 1
    k = Breaker(2, 100)
    k.report(False, 0), k.report(True, 1), k.report(False, 2)
    assert k.state == "closed"
    k.report(False, 3)
    assert not k.allow(102) and k.allow(103) and not k.allow(104)
    k.report(False, 105)
    assert k.state == "open" and k.allow(205)
    k.report(True, 206)
    assert k.state == "closed"


def test_reservations_stay_open_until_settled(spark):
    rows = [("a", 1, "reserve", 0, 0, 50.0), ("a", 2, "reserve", 0, 1, 20.0), ("a", 1, "settle", 0, 2, 70.0), ("a", 1, "settle", 0, 3, 70.0), ("a", 2, "settle", 0, 4, 5.0), ("a", 3, "reserve", 20_000, 5, 5.0)]
    got = traffic.run_reservations(spark.createDataFrame(rows, "tenant string, request bigint, kind string, t bigint, arrival bigint, tokens double"), 60).orderBy("arrival").collect()
    assert [(r.outcome, r.retry_after, r.available) for r in got] == [("admitted", 0, 10), ("exhausted", 10, 10), ("settled", 0, -10), ("ignored", 0, -10), ("ignored", 0, -10), ("admitted", 0, 5)]


def test_failover_drives_the_breakers(spark):
    up, down = {"a": True, "b": True}, {"a": False, "b": True}
    rows = [("p", 0, 0, down, None, False), ("p", 1, 1, down, None, False), ("p", 2, 2, up, None, False), ("p", 50, 3, up, "a", False), ("p", 103, 4, up, "b", False), ("p", 104, 5, down, None, True), ("p", 300, 6, up, "a", False), ("p", 301, 7, up, None, False)]
    got = traffic.run_router(spark.createDataFrame(rows, "pool string, t bigint, arrival bigint, good map<string,boolean>, probe string, cancelled boolean"), ("a", "b"), 2, 100).orderBy("arrival").collect()
    assert [(r.provider, r.attempts, r.states) for r in got] == [
        ("b", 2, "closed,closed"), ("b", 2, "open,closed"), ("b", 1, "open,closed"), (None, 0, "open,closed"), (None, 0, "open,closed"),
        (None, 1, "half_open,closed"), (None, 0, "closed,closed"), ("a", 1, "closed,closed"),
    ]


def test_tenants():
    assert traffic.parse_tenants(" ") == [] and traffic.parse_tenants("x:k1:5, y : k2 : 70") == [("x", "k1", 5), ("y", "k2", 70)]
    for wrong in ("x:k1", "x::5", ":k:5", "x:k:0", "x:k:-3", "x:k:many", "x:k:5,y:k:6", "x:k:5,"):
        with pytest.raises(ValueError):
            traffic.parse_tenants(wrong)


def test_usage_of_a_stream(spark):
    rows = spark.createDataFrame([([(False, None, None), (True, 7, 5)],), ([(False, None, None)],), ([],)], "lines array<struct<done:boolean,prompt_eval_count:bigint,eval_count:bigint>>")
    assert [r[0] for r in rows.select(traffic.usage_total(F.col("lines"))).collect()] == [12, None, None]


def test_cache_key(spark):
    rows = spark.createDataFrame([("north", "model", None, [("user", "grüße"), ("assistant", "")]), ("b", "m", 7, [])], "tenant string, model string, cap int, messages array<struct<role:string,content:string>>")
    got = rows.select(cache_key(F.col("tenant"), F.col("model"), F.col("cap"), F.col("messages"))).collect()
    for row, fields in zip(got, (["north", "model", "0", "\0default", "user", "grüße", "assistant", ""], ["b", "m", "0", "7"]), strict=True):
        raw = b"".join(len(x.encode()).to_bytes(4, "big") + x.encode() for x in fields)
        assert row[0] == hashlib.sha256(raw).hexdigest()


def test_codec():
    rng = random.Random(3)
    for _ in range(60):
        s = [(rng.randrange(-(2**62), 2**62) if rng.random() < 0.1 else 1000 * i + rng.randrange(50), rng.choice([0.0, -0.0, float("inf"), 1.5, rng.random()])) for i in range(rng.randrange(1, 40))]
        back = gorilla.decode(gorilla.encode(s), len(s))
        assert [(t, struct.pack(">d", v)) for t, v in back] == [(t, struct.pack(">d", v)) for t, v in s]
    assert len(gorilla.encode([(1000 * i, 1.0) for i in range(1000)])) <= 300
    with pytest.raises(ValueError):
        gorilla.decode(gorilla.encode([(i * i, i / 3) for i in range(50)])[:60], 50)


def _events(spark, path, rows):
    """The table of events at `path`: (id, seconds, value) of one series."""
    text = [(i, f"2024-01-02 00:00:{s:02d}", 7, "view", float(v), "{}") for i, s, v in rows]
    events = spark.createDataFrame(text, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_equal_sums_of_a_counter_are_no_fall(spark, tmp_path):
    # The sums after events 2 and 4, which come first in time, are 1.8; as floats the second is less.
    assert 0.8 + 0.5 + 0.5 - 0.4 + 0.4 < 0.8 + 0.5 + 0.5
    c = tables.counter(spark, _events(spark, tmp_path, [(0, 5, 0.8), (1, 6, 0.5), (2, 1, 0.5), (3, 7, -0.4), (4, 2, 0.4)]))
    assert [r.v for r in c.orderBy("t").collect()] == [1.8, 1.8, 0.8, 1.3, 1.4]
    for function in ("increase", "rate"):
        assert values(Engine(c).instant(f"{function}(events_total[4s])", 1_704_153_603_999)) == {('{event_type="view",u="7"}', 1_704_153_603_999): 0}
    odd = tables.counter(spark, _events(spark, tmp_path / "odd", [(0, 1, 2e9), (1, 2, 0.5), (2, 3, float("inf"))]))
    assert [r.v for r in odd.orderBy("t").collect()] == [2e9, 2e9 + 0.5, float("inf")]


def test_samples_of_one_arrival_come_by_time(spark):
    rows = [("g", {}, t, float(v), 0, a) for t, v, a in [(9, 1, 1), (5, 2, 1), (5, 3, 1), (7, 4, 1), (8, 5, 2)]]
    for same in (rows, rows[::-1]):
        got = storage.admit(spark.createDataFrame(same, SCHEMA)).collect()
        assert sorted((r.t, r.v, r.status) for r in got) == [(5, 2, "kept"), (5, 3, "ood_dropped"), (7, 4, "kept"), (8, 5, "ood_dropped"), (9, 1, "kept")]
