"""Toxicity: boosted trees over dense text features, with isotonic calibration.

Features: densities of a seed lexicon and of a lexicon learned from the labels, hits
near the second person, capitals, punctuation and obfuscation rates. The classifier is
fitted on at most about `max_train_rows` labelled rows (a bounded sample by a hash of
the id); every text of the input is then scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, held_out, map_texts, narrow_batches, staged
from .gbt import Calibrated

MAX_TRAIN_ROWS = 20_000
MAX_LEXICON = 200
#: Parts of the labelled sample; features of one are made without its labels.
PARTS = 5
SEEDS = frozenset("idiot moron stupid dumb loser pathetic worthless disgusting scum trash garbage clown fool imbecile hate shut ugly filthy vermin crap".split())
YOU = frozenset("you your yours yourself u ur tu te toi vous votre vos du dich dir dein deine ihr euch sie usted ustedes ti tus vosotros".split())
NAMES = (
    "words", "seed_density", "seed_hits", "learned_density", "learned_hits", "learned_best", "you_density", "you_near",
    "capitals", "exclaim", "question", "punctuation", "digits", "obfuscated", "unmasked_hits", "letters",
)
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[A-Za-z]+[0-9@$!*]+[A-Za-z0-9@$!*]*[A-Za-z]|[A-Za-z][*@$][A-Za-z*@$]+")
_PLAIN = str.maketrans("013457@$!", "oieastasi")
_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_LOWER = (_ASCII >= 97) & (_ASCII <= 122)
_LEAD = _ASCII >= 0xC3
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_PUNCT = (_ASCII > 32) & (_ASCII < 127) & ~_UPPER & ~_LOWER & ~_DIGIT


def features(texts: list[str | None], learned: dict[str, float]) -> np.ndarray:
    """One row of `NAMES` per text; null texts count as empty."""
    out = np.zeros((len(texts), len(NAMES)), np.float32)
    known = SEEDS | YOU | learned.keys()
    for i, text in enumerate(texts):
        if not text:
            continue
        low = text.lower()
        words = _WORD.findall(low)
        n = max(1, len(words))
        hits = [(at, w) for at, w in enumerate(words) if w in known]
        you = [at for at, w in hits if w in YOU]
        seed = [at for at, w in hits if w in SEEDS]
        found = [(at, learned[w]) for at, w in hits if w in learned]
        near = 0
        if you and (seed or found):
            at = np.array(you)
            bad = np.unique(seed + [a for a, _ in found])
            k = np.searchsorted(at, bad)
            gap = np.minimum(np.abs(bad - at[np.minimum(k, len(at) - 1)]), np.abs(bad - at[np.maximum(k - 1, 0)]))
            near = int((gap <= 5).sum())
        count = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        letters = int(count[_UPPER].sum() + count[_LOWER].sum() + count[_LEAD].sum())
        masked = _MIXED.findall(text) if count[_PUNCT].sum() + count[_DIGIT].sum() else []
        plain = sum(m.lower().translate(_PLAIN) in known for m in masked)
        size = len(text)
        out[i] = (
            np.log1p(n), 100 * len(seed) / n, len(seed), 100 * len(found) / n, len(found), max((v for _, v in found), default=0),
            100 * len(you) / n, near, count[_UPPER].sum() / max(1, letters), 100 * count[33] / size, 100 * count[63] / size,
            100 * count[_PUNCT].sum() / size, 100 * count[_DIGIT].sum() / size, 100 * len(masked) / n, plain, letters / size,
        )
    return out


def _array(x: np.ndarray) -> pa.Array:
    flat = pa.array(x.astype(np.float32).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


def _lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """The words that most surely mark a toxic text, with their log odds; at most MAX_LEXICON.

    One lexicon without each of the PARTS of the sample, and behind them that of all.
    """
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))
    of = lambda x, k: F.sum(F.when(F.col("part") == k, x).otherwise(0))
    by_word = (
        sample.select("part", "toxic", F.explode(words).alias("word"))
        .filter("word <> ''")
        .groupBy("word")
        .agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("b"), *(of(F.col("toxic"), k).alias(f"a{k}") for k in range(PARTS)), *(of(F.lit(1), k).alias(f"b{k}") for k in range(PARTS)))
    )
    rows = {r["part"]: (r["ones"], r["n"]) for r in sample.groupBy("part").agg(F.sum("toxic").alias("ones"), F.count(F.lit(1)).alias("n")).collect()}
    ones, n = (sum(x[i] for x in rows.values()) for i in (0, 1))
    without = [(ones - x, n - y) for x, y in (rows.get(k, (0, 0)) for k in range(PARTS))] + [(ones, n)]
    bases = [(x + 1) / (y + 2) for x, y in without]
    each = [F.struct(F.lit(k).alias("k"), F.lit(bases[k]).alias("base"), (F.col("a") - F.col(f"a{k}")).alias("a"), (F.col("b") - F.col(f"b{k}")).alias("b")) for k in range(PARTS)]
    each.append(F.struct(F.lit(PARTS).alias("k"), F.lit(bases[PARTS]).alias("base"), "a", "b"))
    z = (F.col("a") - F.col("b") * F.col("base")) / F.sqrt(F.col("b") * F.col("base") * (1 - F.col("base")) + 1)
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("z"), "word"))
    sure = by_word.select("word", F.explode(F.array(*each)).alias("x")).select("word", "x.*").filter("a >= 4").withColumn("z", z).filter("z > 4")
    out: list[dict[str, float]] = [{} for _ in bases]
    for r in sure.withColumn("rank", rank).filter(F.col("rank") <= MAX_LEXICON).orderBy("k", "rank").collect():
        out[r["k"]][r["word"]] = float(np.log((r["a"] + 0.5) / (r["b"] - r["a"] + 0.5) / (r["base"] / (1 - r["base"]))))
    return out


def _features(sample: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """(doc_id, toxic, fold, x): features of the sample, each part by its own lexicon."""
    out = None
    for k, words in enumerate(lexicons):
        one = map_texts(sample.filter(F.col("part") == k), lambda words=words: lambda t: [_array(features(t, words))], "x array<float>", ("toxic", "fold"))
        out = one if out is None else out.unionByName(one)
    return out


def learn(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Callable[[list[str | None]], np.ndarray]:
    """Fit on labelled, not held-out rows of `docs`; returns texts -> scores.

    Rows of `labels` with a null id or label are left out; of several labels of a
    document the largest counts. Without any usable label all scores are 0.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    per_doc = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = per_doc.count()
    part = min(1.0, max_train_rows / max(1, n))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    chosen = per_doc.withColumn("fold", fold).filter(F.col("fold") < int(part * 1_000_003) + (part >= 1))
    # At most about max_train_rows rows of three numbers, by the hash: small enough to broadcast at any input size.
    sample = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", "fold"), "labelled")
    sample = sample.withColumn("part", F.pmod("fold", F.lit(PARTS)))
    *others, learned = _lexicons(sample)
    # Features of a part come from the other parts' lexicon: no label reaches its own row's features.
    made = _features(sample, others).toPandas()
    made = made.sort_values(["fold", "doc_id"])
    x = np.array(made["x"].tolist(), np.float32).reshape(len(made), len(NAMES))
    model = Calibrated().fit(x, made["toxic"].to_numpy(float), made["fold"].to_numpy())
    return lambda texts: model.score(features(texts, learned))


def toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts are scored by their (zero) features. Rows that repeat an id
    are scored each. Columns other than doc_id and text are not read.
    """
    score = learn(docs, labels, max_train_rows)
    scored = map_texts(docs, lambda: lambda t: [pa.array(score(t).astype(float))], "score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of `docs` that the classifier does not predict toxic, all columns kept."""
    score = learn(docs, labels, max_train_rows)

    @F.arrow_udf("double")
    def judge(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], names=["text"])
        return pa.array(np.concatenate([np.zeros(0), *(score(part.column(0).to_pylist()).astype(float) for part in by_bytes(batch, 0))]))

    narrow_batches(docs.sparkSession)
    return docs.filter(judge("text") < 0.5)
