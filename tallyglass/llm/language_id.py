"""Language identification by interpolated Kneser-Ney character models.

One model of order `ORDER` per language, over lower-cased letters with everything else
as one blank. n-grams pack into 64 bits, so the sorted arrays of their (bijective)
hashes hold no collisions; one look-up serves all languages. A text gets the language
of the lowest length-normalised cross-entropy. The score is the calibrated probability
that this is right; `rejected` marks scores below one half.

The classifier is fitted on at most about `max_train_rows` texts per language, chosen by
a hash of the id.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_arrow, map_texts, staged
from .hashing import U, mix

ORDER = 4
MAX_TRAIN_ROWS = 4000
#: Rows, the first by a hash of the id, that calibrate the score.
MAX_TUNE_ROWS = 2000
_BLANK = 32


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: itself if a letter or mark (beyond the first plane: one code for all), else a blank."""
    kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    code = np.minimum(np.arange(0x110000), 0xFFFF)
    return np.where(np.isin(kind, ["L", "M"]), code, _BLANK).astype(np.uint16), np.array(kind) == "L"


_TABLE: list[tuple[np.ndarray, np.ndarray]] = []


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, each with ORDER - 1 blanks before and one behind; starts; whether a text has a letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    raw = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    flat = np.full(int(size.sum()) + ORDER * len(raw), _BLANK, np.uint32)
    start = np.cumsum(np.r_[0, size + ORDER])
    for r, s in zip(raw, start, strict=False):
        flat[s + ORDER - 1 : s + ORDER - 1 + len(r)] = r
    table, is_letter = _TABLE[0]
    code = table[flat]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != _BLANK) | (code[:-1] != _BLANK)  # runs of blanks become one,
    for k in range(ORDER - 1):  # but for those that open a text
        keep[start[:-1] + k] = True
    letter = np.add.reduceat(is_letter[flat].astype(np.int64), start[:-1]) > 0 if len(raw) else np.zeros(0, bool)
    n = np.cumsum(np.r_[0, keep])[start]
    return code[keep], n, letter


def grams(code: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (one per predicted character) and the text of each."""
    n = len(code) - ORDER + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    key = np.zeros(n, U)
    for i in range(ORDER):
        key = (key << U(16)) | code[i : i + n].astype(U)
    text = np.repeat(np.arange(len(start) - 1), np.diff(start))[:n]
    inside = np.arange(n) + ORDER <= start[text + 1]
    return key[inside], text[inside]


class Sorted:
    """Rows by key, in arrays sorted by the hash of the key; a missing key finds row -1."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        h = mix(keys)
        order = np.argsort(h)
        self.h, self.rows = h[order], rows[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.full(len(keys), -1)
        h = mix(keys)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)


class KneserNey:
    """Interpolated Kneser-Ney over several languages at once: fit(lang, key, count)."""

    def fit(self, langs: list[str], lang: np.ndarray, key: np.ndarray, count: np.ndarray) -> KneserNey:
        self.langs, n_lang = langs, len(langs)
        seen = np.unique(key & U(0xFFFF))
        self.floor = 1.0 / (len(seen) + 1)
        levels = []
        for order in range(ORDER, 0, -1):
            keys, at = np.unique(key, return_inverse=True)
            c = np.zeros((len(keys), n_lang))
            np.add.at(c, (at, lang), count)
            levels.append((keys, c))
            # The next lower order counts distinct left contexts.
            mask = U((1 << 16 * (order - 1)) - 1)
            li, ki = np.nonzero(c.T)
            low, at = np.unique(np.stack([li.astype(U), keys[ki] & mask], 1), axis=0, return_inverse=True)
            lang, key, count = low[:, 0].astype(int), low[:, 1], np.bincount(at.ravel(), minlength=len(low)).astype(float)
        self.levels = []
        lower = None
        for order, (keys, c) in zip(range(1, ORDER + 1), reversed(levels), strict=True):
            ones, twos = (c == 1).sum(0), (c == 2).sum(0)
            d = np.where(ones + twos > 0, ones / np.maximum(1, ones + 2 * twos), 0.5).clip(0.1, 0.95)
            ctx, at = np.unique(keys >> U(16), return_inverse=True)
            total, kinds = np.zeros((len(ctx), n_lang)), np.zeros((len(ctx), n_lang))
            np.add.at(total, at, c)
            np.add.at(kinds, at, c > 0)
            gamma = np.where(total > 0, d * kinds / np.maximum(1, total), 1.0)
            base = self.floor if lower is None else self._lower(lower, keys & U((1 << 16 * (order - 1)) - 1))
            p = np.where(total[at] > 0, np.maximum(c - d, 0) / np.maximum(1, total[at]), 0) + gamma[at] * base
            lower = (Sorted(keys, p), Sorted(ctx, gamma))
            self.levels.append(lower)
        top = self.levels[-1][0]
        self.logs = np.log2(top.rows).astype(np.float32)
        return self

    def _lower(self, level: tuple[Sorted, Sorted], keys: np.ndarray) -> np.ndarray:
        return level[0].rows[level[0].find(keys)]

    def _prob(self, order: int, keys: np.ndarray) -> np.ndarray:
        if not order:
            return np.full((len(keys), len(self.langs)), self.floor)
        table, ctx = self.levels[order - 1]
        at = table.find(keys)
        out = table.rows[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            k = keys[miss]
            c = ctx.find(k >> U(16))
            gamma = np.where((c >= 0)[:, None], ctx.rows[c], 1.0)
            out[miss] = gamma * self._prob(order - 1, k & U((1 << 16 * (order - 1)) - 1))
        return out

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per character (texts x languages), characters, and whether there is a letter."""
        code, start, letter = codes(texts)
        key, text = grams(code, start)
        top = self.levels[-1][0]
        at = top.find(key)
        bits = self.logs[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            bits[miss] = np.log2(self._prob(ORDER, key[miss]))
        n = np.bincount(text, minlength=len(texts))
        out = np.stack([-np.bincount(text, bits[:, j], len(texts)) for j in range(len(self.langs))], 1)
        return out / np.maximum(1, n)[:, None], n, letter


def _margin(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = h.argmin(1)
    two = np.partition(h, 1, axis=1)[:, :2] if h.shape[1] > 1 else np.c_[h[:, 0], h[:, 0] + 1]
    return best, np.log1p((two[:, 1] - two[:, 0]) * n), two[:, 0]


class Identifier:
    """Model and calibration; call it with texts for (language, score, rejected, bits)."""

    def __init__(self, model: KneserNey, texts: list[str], lang: np.ndarray):
        self.model = model
        self.a, self.b, self.usual = 1.5, -1.0, np.full((len(model.langs), 2), (3.0, 1.0))
        if not len(texts):
            return
        h, n, letter = model.entropy(texts)
        best, m, low = _margin(h, n)
        right = (best == lang).astype(float)
        for k in range(len(model.langs)):
            own = low[(lang == k) & letter]
            if len(own) >= 5:
                self.usual[k] = own.mean(), max(0.15, own.std())
        # Logistic regression of being right on the margin, with a weak prior, by Newton steps.
        x, w = np.c_[m, np.ones(len(m))], np.array([self.a, self.b])
        prior = w.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
            grad = x.T @ (right - p) - (w - prior)
            w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), grad)
        self.a, self.b = w

    def __call__(self, texts: list[str | None]) -> list[pa.Array]:
        h, n, letter = self.model.entropy(texts)
        best, m, low = _margin(h, n)
        mean, sd = self.usual[best].T
        odd = (low - mean) / sd * np.sqrt(np.minimum(1, n / 40))  # far more bits than the language has
        score = 1 / (1 + np.exp(-(self.a * m + self.b).clip(-30, 30))) / (1 + np.exp((odd - 8).clip(-30, 30)))
        name = np.array([*self.model.langs, "und"], object)[np.where(letter, best, -1)]
        score = np.where(letter, score, 0.0)
        return [pa.array(name.tolist(), pa.string()), pa.array(score), pa.array(score < 0.5), pa.array(low)]


def _counts(batches):
    """Distinct n-grams of each language with their counts, per batch."""
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            langs = np.array(part.column(0).to_pylist(), object)
            code, start, _ = codes(part.column(1).to_pylist())
            key, text = grams(code, start)
            for one in np.unique(langs):
                k, c = np.unique(key[(langs == one)[text]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "key", "n"])


def learn(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Identifier | None:
    """Fit on rows with a language that are not held out; None if there are none."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return None
    langs = sorted(n)
    limit = F.create_map(*[F.lit(x) for k in langs for x in (k, int((1 << 30) * min(1.0, max_train_rows / n[k])))])
    sample = staged(rows.filter(mark < limit[F.col("lang")]).withColumn("tune", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(8)) == 0), "sample")
    fit = sample.filter("not tune") if min(n.values()) >= 20 else sample
    counted = in_arrow(fit.select("lang", "text"), _counts, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    code = {k: i for i, k in enumerate(langs)}
    model = KneserNey().fit(langs, got["lang"].map(code).to_numpy(int), got["key"].to_numpy(np.int64).view(U), got["n"].to_numpy(float))
    tune = sample.filter("tune").withColumn("place", F.xxhash64("doc_id", F.lit(2))).orderBy("place", "doc_id", "text").select("text", "lang").limit(MAX_TUNE_ROWS).toPandas()
    return Identifier(model, tune["text"].tolist(), tune["lang"].map(code).to_numpy())


def identify(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected, bits_per_char.

    `und` with score 0 where the text is null or has no letter, or nothing could be
    learned. Equal cross-entropies go to the first language by name. Only doc_id, text
    and (for learning) lang are read.
    """
    found = learn(docs, max_train_rows)

    def nothing(texts: list[str | None]) -> list[pa.Array]:
        n = len(texts)
        return [pa.array(["und"] * n), pa.array([0.0] * n), pa.array([True] * n), pa.array([0.0] * n)]

    out = map_texts(docs, lambda: found or nothing, "lang_pred string, score double, rejected boolean, bits_per_char double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected", "bits_per_char")
