"""Schemas and label helpers of metrics and traces. Metric times are ms, span times ns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRIC = "name string, labels map<string,string>, timestamp bigint, value double"
SPAN = "trace_id string, span_id string, parent_id string, name string, start bigint, end bigint, attrs map<string,string>"
BATCH = f"spans array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>, metrics array<struct<{METRIC.replace(' ', ':').replace(',:', ',')}>>"
#: Columns of a sample table: identity, time, value, and order of arrival.
SAMPLE = ("name", "labels", "t", "v", "epoch", "arrival")


def quoted(value: Column) -> Column:
    """A label value in double quotes, with quotes, backslashes and common controls escaped."""
    for char, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        value = F.replace(value, F.lit(char), F.lit(escape))
    return F.concat(F.lit('"'), value, F.lit('"'))


def series_key(labels: Column, name: Column | None = None) -> Column:
    """Canonical identity: name{a="x",b="y"}, labels by name."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), quoted(e["value"])))
    body = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    return body if name is None else F.concat(F.coalesce(name, F.lit("")), body)


def label(labels: Column, key: str) -> Column:
    return F.coalesce(F.element_at(labels, key), F.lit(""))


def legend(labels: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: e["value"]), " · ")


def fnv32(text: Column) -> Column:
    """Low 32 bits of the 64-bit FNV-1a hash: they depend on the low 32 bits of the state only."""
    code = F.hex(F.encode(text, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(code), F.lit(2))
    bytes_ = F.when(F.length(code) > 0, F.transform(places, lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(bytes_, F.lit(0x84222325).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 435).bitwiseAND(F.lit(0xFFFFFFFF)))


def sampled(trace_id: Column, ratio: float) -> Column:
    """Whether a trace is kept at `ratio` (1 and more: all; 0 and less: none)."""
    if ratio >= 1 or ratio <= 0:
        return F.lit(ratio >= 1)
    return fnv32(trace_id) < int(ratio * 2**32)
