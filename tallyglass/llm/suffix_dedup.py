"""Substring dedup by suffix naming over a content-aligned difference cover.

A difference cover samples suffixes so that any two suffixes reach sampled ones at a
common distance; sampled suffixes get names, names are named again, and the suffixes
between are merged by what stands before the next sample. Residues mod 3 need a record
per byte and level. Here the cover is local and content-aligned: position a is sampled
if the `GRAM`-byte string there is the smallest (by hash, leftmost) of some window of
`length` bytes. Equal windows sample at equal distances, which is the property that the
merge needs, at about 1.5 records per 100 bytes. The steps:

1. every sampled position gets the name h of its first bytes; names that occur once
   stand in no repeated window and go;
2. names are named again: g stands for the run of windows [lo, hi] that share the
   sample, bytes included. Equal g: all windows of the run are repeated;
3. where one h has several g, names are named once more, for blocks of `BLOCK` windows
   at equal distances from the sample: by the bytes that all windows of a block share,
   and by all of its bytes;
4. where that leaves several, the suffixes between (one per window of the block) are
   merged by that name and the few bytes that stand before and behind;
5. adjacent equal entries, that is entries with a common prefix of `length`, are
   repeated windows. Their union is what goes.

Names are compared as pairs of independent 64-bit fingerprints, and only among equal h.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, discard, in_arrow, release, staged
from .hashing import U, Spans, mix, sliding_min

LENGTH = 200
GRAM = 64
BLOCK = 16
#: Long texts are worked on in overlapping pieces of so many bytes; windows see no difference.
PIECE = 1 << 19
_POS = 28  # bits of a packed value that hold the position


def _runs(data: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of valid window starts with one sampled position a: lo, hi, a, h, g."""
    spans = Spans(data)
    packed = (spans.grams(gram) >> U(_POS) << U(_POS)) | np.arange(max(0, len(data) - gram + 1), dtype=U)
    sample = (sliding_min(packed, length - gram + 1) & U((1 << _POS) - 1)).astype(np.int64)
    at = np.flatnonzero(valid[: len(sample)])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    cut = np.flatnonzero((np.diff(sample[at]) != 0) | (np.diff(at) != 1)) + 1
    lo, hi = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]]
    a = sample[lo]
    h = spans(a, a + gram)
    g = Spans(data, second=True)(lo, hi + length) ^ (a - lo).astype(U) * U(0x9E3779B97F4A7C15)
    return lo, hi, a, h, g


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Byte arrays of about PIECE bytes: data, valid window starts, and row and offset by byte."""
    some: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), PIECE):
            part = t[s : s + PIECE + length - 1]
            if len(part) < length:
                continue
            some.append((i, s, part))
            size += len(part)
            if size >= PIECE:
                yield _join(some, length)
                some, size = [], 0
    if some:
        yield _join(some, length)


def _join(some: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for _, _, p in some])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(p for _, _, p in some), np.uint8)
    valid = np.zeros(len(data), bool)
    for a, n in zip(starts, sizes, strict=True):
        valid[a : a + n - length + 1] = True
    row = np.repeat([i for i, _, _ in some], sizes)
    offset = np.arange(len(data)) - np.repeat(starts, sizes) + np.repeat([s for _, s, _ in some], sizes)
    return data, valid, row, offset


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _sample(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 2):
                for data, valid, row, offset in _pieces(_encoded(part.column(2)), length):
                    lo_, hi, a, h, g = _runs(data, valid, length, gram)
                    take = pa.array(row[lo_])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(1).take(take), pa.array(offset[lo_], pa.int32()),
                         pa.array(offset[hi], pa.int32()), pa.array(offset[a], pa.int32()), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))],
                        names=["doc_id", "tag", "lo", "hi", "at", "h", "g"],
                    )

    return run


def _blocks(length: int, block: int):
    """For each text with runs (lo, hi, h, alone): the blocks of its runs.

    A block has the name h of the bytes that all its windows share, the name g of all
    its bytes, and the bytes before and behind the shared ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(_encoded(batch.column(2).slice(i, 1))[0], np.uint8)
                runs = batch.column(3)[i].values
                lo_, hi_, at_ = (runs.field(k).to_numpy().astype(np.int64) for k in (0, 1, 2))
                h_, alone_ = runs.field(3).to_numpy().view(U), runs.field(4)
                order = np.argsort(lo_, kind="stable")
                for part in np.array_split(order, max(1, len(order) // 4096)):
                    # Blocks are counted from the sample at `a`, so that equal windows fall in equal blocks.
                    last = (at_[part] - lo_[part]) // block
                    none = (at_[part] - hi_[part]) // block
                    n = last - none + 1
                    of = np.repeat(part, n)
                    k = np.repeat(none, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    hi = np.minimum(hi_[of], at_[of] - k * block)
                    lo = np.maximum(lo_[of], at_[of] - k * block - (block - 1))
                    first, end = int(lo.min()), int(hi.max()) + length
                    bytes_ = data[first:end]
                    one, two = Spans(bytes_), Spans(bytes_, second=True)
                    a, b = lo - first, hi - first
                    # What every window of a whole block shares, also where the run ends within the block.
                    left = at_[of] - k * block - first
                    right = left + length - (block - 1)
                    core = one(left, right) ^ two(left, right)
                    h = mix(core + mix(h_[of] + k.astype(U)))
                    g = two(a, b + length) ^ mix((at_[of] - lo).astype(U))
                    raw = bytes_.tobytes()
                    before = [raw[x:y] for x, y in zip(a.tolist(), left.tolist(), strict=True)]
                    behind = [raw[x : y + length] for x, y in zip(right.tolist(), b.tolist(), strict=True)]
                    take = pa.array(np.full(len(lo), i))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()),
                         pa.array((left - b).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)),
                         pa.array(before, pa.binary()), pa.array(behind, pa.binary()), alone_.take(pa.array(of))],
                        names=["doc_id", "tag", "lo", "hi", "far", "h", "g", "before", "behind", "alone"],
                    )

    return run


def _windows(block: int):
    """(h, w) of every window of the blocks: w names its distance and the bytes around the shared ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                lo, hi, far = (part.column(k).to_numpy().astype(np.int64) for k in (2, 3, 4))
                around = [x + y for x, y in zip(part.column(6).to_pylist(), part.column(7).to_pylist(), strict=True)]
                start = np.cumsum([0, *map(len, around)])
                n = hi - lo + 1
                of = np.repeat(np.arange(len(lo)), n)
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = start[of] + j
                w = Spans(np.frombuffer(b"".join(around), np.uint8))(at, at + block - 1) ^ mix((far[of] + n[of] - j).astype(U))
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(lo[of] + j, pa.int32()), part.column(5).take(take),
                     pa.array(w.view(np.int64)), part.column(8).take(take)],
                    names=["doc_id", "tag", "p", "h", "w", "alone"],
                )

    return run


def _cut(length: int):
    """What is left of each text without the windows of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, data in enumerate(_encoded(batch.column(1))):
                runs = batch.column(2)[i].values
                spans: list[tuple[int, int]] = []
                if runs is not None and len(runs):
                    lo, hi = (runs.field(k).to_numpy() for k in (0, 1))
                    order = np.argsort(lo, kind="stable")
                    lo, end = lo[order], np.maximum.accumulate(hi[order].astype(np.int64) + length)
                    new = np.r_[True, lo[1:] > end[:-1]]
                    first = np.flatnonzero(new)
                    spans = list(zip(lo[first].tolist(), end[np.r_[first[1:] - 1, len(lo) - 1]].tolist(), strict=True))
                sha, at, gone = hashlib.sha256(), 0, 0
                for a, b in spans:
                    sha.update(data[at:a])
                    at, gone = b, gone + b - a
                sha.update(data[at:])
                out.append((len(data), gone, len(spans), sha.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return run


def _same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the row key (doc_id, tag), nulls equal."""
    b = b.withColumnsRenamed({"doc_id": "__d", "tag": "__t"})
    return a.join(b, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("tag") == F.col("__t")), how).drop("__d", "__t")


def _named(runs: DataFrame) -> DataFrame:
    """The runs whose name h occurs again, with `several`: not all of its g are equal."""
    names = staged(
        runs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("g0"), F.max("g").alias("g1"))
        .filter("n > 1").selectExpr("h", "g0 <> g1 AS several"),
        "names",
    )
    release(runs.sparkSession)
    shared = staged(runs.join(names, "h"), "shared")
    discard(names)
    return shared


def repeated_windows(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(doc_id, tag, lo, hi): runs of window starts whose `length` bytes also start elsewhere."""
    key = f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, tag int"
    span = ["doc_id", "tag", "lo", "hi"]
    runs = staged(in_arrow(keyed, _sample(length, gram), f"{key}, lo int, hi int, at int, h bigint, g bigint"), "runs")
    shared = _named(runs)
    discard(runs)
    several = shared.filter("several")
    second = staged(several.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*span, "at")).alias("one")), "second")
    whole = shared.filter("not several").select(*span)
    again = several.join(second.filter("n > 1").select("h", "g"), ["h", "g"]).select(*span)
    asked = (
        second.select("one.*", "h", (F.col("n") == 1).alias("alone"))
        .groupBy("doc_id", "tag").agg(F.collect_list(F.struct("lo", "hi", "at", "h", "alone")).alias("runs"))
    )
    with_text = _same(keyed, asked).select("doc_id", "tag", "text", "runs").dropDuplicates(["doc_id", "tag"])
    blocks = staged(
        in_arrow(with_text, _blocks(length, block), f"{key}, lo int, hi int, far int, h bigint, g bigint, before binary, behind binary, alone boolean"), "blocks"
    )
    release(keyed.sparkSession)
    near = _named(blocks)
    discard(blocks)
    mixed = near.filter("several")
    third = staged(
        mixed.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*span, "far", "before", "behind", "alone")).alias("one")), "third"
    )
    own = near.filter("alone")
    whole2 = own.filter("not several").select(*span)
    again2 = own.filter("several").join(third.filter("n > 1").select("h", "g"), ["h", "g"]).select(*span)
    windows = third.select("one.doc_id", "one.tag", "one.lo", "one.hi", "one.far", "h", "one.before", "one.behind", (F.col("one.alone") & (F.col("n") == 1)).alias("alone"))
    merged = staged(in_arrow(windows, _windows(block), f"{key}, p int, h bigint, w bigint, alone boolean"), "windows")
    # Written first: Spark can split a hot name only where both sides of the join come straight from a shuffle.
    equal = staged(merged.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "w"), "equal")
    found = merged.filter("alone").join(equal, ["h", "w"]).select("doc_id", "tag", F.col("p").alias("lo"), F.col("p").alias("hi"))
    out = staged(whole.unionByName(again).unionByName(whole2).unionByName(again2).unionByName(found), "repeated")
    discard(shared, second, near, third, merged, equal)
    return out


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Texts are UTF-8 bytes, null ones empty; no match crosses a text's end. Removed is
    every byte of a window of `length` bytes that starts anywhere else too (in any row,
    at any other place of the same text included). Rows that repeat an id and a text
    repeat each other. Columns other than doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.hash("text").alias("tag"), text.alias("text"))
    runs = repeated_windows(keyed, length, gram)
    per_doc = runs.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    both = _same(keyed, per_doc, "left").select("doc_id", "text", "runs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(
        both,
        _cut(length),
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>",
    )
