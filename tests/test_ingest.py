"""Ingest from a landing folder: validation, fan-out, order of arrival, restart."""

import json
import os

from tallyglass.plans.engine import Engine
from tallyglass.sources.batches import MAX_BYTES, accepted, fan_out, read_batches
from tallyglass.streaming.ingest import ingest, read_metrics, read_spans

POINT = {"name": "load", "labels": {"host": "h1"}, "timestamp": 1_000, "value": 2.5}
SPAN = {"trace_id": "t", "span_id": "s", "parent_id": "", "name": "work", "start": 10, "end": 30, "attrs": {"k": "v"}}


def put(folder, name, *lines, at=None):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))
    if at:
        os.utime(path, (at, at))


def points(*times):
    return {"metrics": [POINT | {"timestamp": t, "value": float(t)} for t in times]}


def test_validation(spark, tmp_path):
    good = [{"metrics": [POINT]}, {"spans": [SPAN]}, {"spans": [SPAN], "metrics": [POINT, POINT | {"labels": {}}]}, {}]
    bad = ["not json", "[1, 2]", {"metrics": [POINT, POINT | {"name": ""}]}, {"spans": [SPAN | {"span_id": ""}]}, {"spans": [SPAN | {"end": 9}]}, {"metrics": [POINT | {"labels": {"x": "y" * MAX_BYTES}}]}]
    put(tmp_path / "in", "a.json", *good, *bad)
    got = read_batches(spark, str(tmp_path / "in"))
    assert [r.ok for r in got.select("raw", accepted(got).alias("ok")).collect()] == [True] * len(good) + [False] * len(bad)


def test_arrival_follows_files_and_lines(spark, tmp_path):
    put(tmp_path / "in", "late.json", points(5, 6), "broken", points(7), at=2_000)
    put(tmp_path / "in", "z_early.json", points(1, 2), points(3), points(4), at=1_000)
    samples, _ = fan_out(read_batches(spark, str(tmp_path / "in")).persist(), 3)
    rows = samples.orderBy("arrival").collect()
    assert [r.t for r in rows] == [1, 2, 3, 4, 5, 6, 7] and {r.epoch for r in rows} == {3}
    assert len({r.arrival for r in rows}) == 7


def test_restart_writes_each_epoch_once(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run():
        ingest(spark, landing, out, checkpoint, max_series=2).awaitTermination()

    put(tmp_path / "in", "a.json", points(1_000, 3_000, 2_000), {"spans": [SPAN, SPAN | {"span_id": "s2"}]}, "broken")
    run()
    first = sorted(map(str, read_metrics(spark, out).collect()))
    # As after a crash: the micro-batch was written, but its commit is gone.
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    for crc in (tmp_path / "checkpoint" / "commits").glob(".*.crc"):
        crc.unlink()
    put(tmp_path / "in", "b.json", points(4_000), {"metrics": [POINT | {"labels": {"host": f"h{i}"}} for i in (7, 8, 9)]})
    run()
    found = read_metrics(spark, out).collect()
    assert sorted(str(r) for r in found if r.epoch == 0) == first
    assert sorted(r.t for r in found if r.labels["host"] == "h1") == [1_000, 3_000, 4_000]
    assert len({r.labels["host"] for r in found}) == 2  # h1 and one more: the cap holds for each epoch
    assert sorted(r.span_id for r in read_spans(spark, out).collect()) == ["s", "s2"]
    assert [r.raw for r in spark.read.parquet(f"{out}/rejected").collect()] == ["broken"]
    dropped = {(r.epoch, r.status): r.n for r in spark.read.parquet(f"{out}/dropped").collect()}
    assert dropped == {(0, "ood_dropped"): 1, (1, "series_rejected"): 2}
    assert Engine(read_metrics(spark, out), 10_000).instant("count(load)", 4_000).first().v >= 1
