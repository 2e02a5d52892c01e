"""A bit-packing codec for (t, v) series: delta-of-delta times, XORed values."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the format: prefix, prefix bits, payload bits, smallest delta of delta.
CLASSES = ((0b10, 2, 7, -64 + 1), (0b110, 3, 9, -256 + 1), (0b1110, 4, 12, -2048 + 1))
_M = (1 << 64) - 1


class _Writer:
    """Bits, most significant first."""

    def __init__(self):
        self.bytes, self.value, self.size = bytearray(), 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value = self.value << bits | value & ((1 << bits) - 1)
        self.size += bits
        rest = self.size % 8
        self.bytes += (self.value >> rest).to_bytes((self.size - rest) // 8, "big")
        self.value &= (1 << rest) - 1
        self.size = rest

    def done(self) -> bytes:
        if self.size:
            self.put(0, 8 - self.size)
        return bytes(self.bytes)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, bits: int) -> int:
        end = self.at + bits
        if end > 8 * len(self.data):
            raise ValueError("the block ends early")
        word = int.from_bytes(self.data[self.at // 8 : (end + 7) // 8], "big") >> (-end % 8)
        self.at = end
        return word & ((1 << bits) - 1)


def _signed(x: int) -> int:
    x &= _M
    return x - (1 << 64) if x >> 63 else x


def encode(samples: list[tuple[int, float]]) -> bytes:
    out = _Writer()
    last = delta = bits = 0
    lead = tail = 65  # no window yet
    for i, (t, v) in enumerate(samples):
        raw = struct.unpack(">Q", struct.pack(">d", v))[0]
        if i == 0:
            out.put(t, 64)
            out.put(raw, 64)
        else:
            dod = _signed(t - last - delta)
            delta = _signed(t - last)
            if dod == 0:
                out.put(0, 1)
            else:
                for prefix, n, size, low in CLASSES:
                    if low <= dod < low + (1 << size):
                        out.put(prefix, n)
                        out.put(dod - low, size)
                        break
                else:
                    out.put(0b1111, 4)
                    out.put(dod, 64)
            x = raw ^ bits
            if x == 0:
                out.put(0, 1)
            else:
                z = min(31, 64 - x.bit_length())
                e = (x & -x).bit_length() - 1
                if z >= lead and e >= tail:
                    out.put(0b10, 2)
                    out.put(x >> tail, 64 - lead - tail)
                else:
                    lead, tail = z, e
                    out.put(0b11, 2)
                    out.put(lead, 5)
                    out.put(64 - lead - tail - 1, 6)
                    out.put(x >> tail, 64 - lead - tail)
        last, bits = t, raw
    return out.done()


def decode(data: bytes, n: int) -> list[tuple[int, float]]:
    """The n samples of a block; ValueError if it ends before."""
    r, out = _Reader(data), []
    t = delta = bits = lead = tail = 0
    for i in range(n):
        if i == 0:
            t, bits = _signed(r.take(64)), r.take(64)
        else:
            dod = 0
            if r.take(1):
                for _, _, size, low in CLASSES:
                    if not r.take(1):
                        dod = r.take(size) + low
                        break
                else:
                    dod = _signed(r.take(64))
            delta = _signed(delta + dod)
            t = _signed(t + delta)
            if r.take(1):
                if r.take(1):
                    lead = r.take(5)
                    tail = 64 - lead - r.take(6) - 1
                bits ^= r.take(64 - lead - tail) << tail
        out.append((t, struct.unpack(">d", struct.pack(">Q", bits))[0]))
    return out


def encoded(series: DataFrame, key: str = "series_key") -> DataFrame:
    """One block per series of (key, t, v): samples, block. A series is one group, as it is one block."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        return pd.DataFrame({key: [rows[key].iloc[0]], "samples": [len(rows)], "block": [encode(list(zip(rows["t"].tolist(), rows["v"].tolist(), strict=True)))]})

    return series.select(key, "t", "v").groupBy(key).applyInPandas(one, f"{key} string, samples bigint, block binary")


def report(series: DataFrame, key: str = "series_key") -> DataFrame:
    """Raw and encoded bytes, bytes a sample and ratio of each series."""
    b = F.octet_length("block").cast("long")
    return encoded(series, key).select(key, "samples", (F.col("samples") * 16).alias("raw_bytes"), b.alias("encoded_bytes"), (b / F.col("samples")).alias("bytes_per_sample"), (F.col("samples") * 16 / b).alias("ratio"))


def total(reported: DataFrame) -> DataFrame:
    """One row for all series of a `report`."""
    raw, small = F.sum("raw_bytes"), F.sum("encoded_bytes")
    return reported.agg(F.sum("samples").alias("samples"), raw.alias("raw_bytes"), small.alias("encoded_bytes"), (small / F.sum("samples")).alias("bytes_per_sample"), (raw / small).alias("ratio"))


def time_bits(key: str = "series_key", t: str = "t") -> Column:
    """Bits that the codec spends on each timestamp, as a window expression."""
    w = Window.partitionBy(key).orderBy(t)
    delta = F.col(t) - F.lag(t).over(w)
    dod = F.col(t) - F.lag(t).over(w) - F.coalesce(F.lag(t).over(w) - F.lag(t, 2).over(w), F.lit(0))
    cost = F.when(dod == 0, 1)
    for _, n, size, low in CLASSES:
        cost = cost.when(dod.between(low, low + (1 << size) - 1), n + size)
    return F.when(delta.isNull(), 64).otherwise(cost.otherwise(68))
