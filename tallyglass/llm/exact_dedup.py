"""Exact dedup by skew-safe combining.

Texts are equal when identical after each run of white space (space, tab to carriage
return) becomes one space. A count of digests marks those that occur again, in bitmaps
of bounded size; rows that no mark can mean are surely unique and never move. The rest
is combined three times, always by digest *and* the whole normalised text: within each
task, then within salted digest groups, then over the winners of the salts. The salt is
that of the reading task, so a task sends one row per distinct text however many copies
it has read, and a group of any size reaches the last step as one row per salt. The plan
is the same at every size; once the marks are full, all distinct texts move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, marks, settled, staged, with_marks

WHITE = r"[\x20\x09-\x0D]+"
SALTS = 64


def _norm() -> Column:
    return F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), WHITE, " ")


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. A null doc_id ranks after all others; it is kept only if
    its whole group has no id. Rows that repeat a doc_id with an equal text are all
    `kept` if that id is the smallest (they are one document, listed repeatedly).
    An empty input gives an empty result. Other columns are ignored.
    """
    ids = staged(docs.select("doc_id", _digest(_norm()).alias("digest")), "digests")
    again = ids.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    texts = docs.select("doc_id", _norm().alias("norm")).withColumn("digest", _digest(F.col("norm")))
    marked = marks(again, "digest")
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    some = with_marks(texts, marked, "digest").filter("__maybe").select("doc_id", "digest", "norm", salt.alias("salt"))
    members = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    salted = staged(some.groupBy("digest", "salt", "norm").agg(*members), "salted")
    whole = [F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    groups = staged(salted.groupBy("digest", "norm").agg(*whole).filter("group_size > 1"), "groups")
    discard(marked, salted)
    by_digest = staged(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size")), "by_digest")
    plain = by_digest.filter("texts = 1").select("digest", "keep_id", "group_size")
    clash = by_digest.filter("texts > 1").select("digest")
    clashing = not clash.isEmpty()
    single = (ids.join(clash, "digest", "left_anti") if clashing else ids).join(plain, "digest", "left")
    if clashing:
        # Digests that several texts share (never seen): the texts themselves settle them.
        by_text = texts.join(clash, "digest", "left_semi").join(groups, ["digest", "norm"], "left")
        single = single.unionByName(by_text.select(*single.columns))
    lone = F.col("group_size").isNull()
    return single.select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (lone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each text, that of the smallest doc_id, all columns kept.

    Rows are judged by doc_id and text together: a row stays if no row of a smaller
    doc_id has its text, whatever other texts stand under its own doc_id. Of rows that
    repeat both, one stays (which of them, where other columns differ, is open).
    """
    groups = settled(lambda: exact_groups(docs).filter("group_size > 1").select("doc_id", "kept", "text_sha256").groupBy("doc_id", "kept", "text_sha256").agg(F.count(F.lit(1)).alias("n")), "groups")
    keys = ("__row_digest",)
    own = docs.withColumn("__row_digest", F.sha2(_norm().cast("binary"), 256))
    # Only rows of repeated texts are shuffled, to be judged; the bitmaps let the others pass by.
    near = with_marks(own, marks(groups, "text_sha256"), *keys)
    lost = groups.filter("not kept").select(F.col("doc_id").alias("__gone_id"), F.col("text_sha256").alias("__gone"))
    match = lambda d: d["__row_digest"].eqNullSafe(F.col("__gone")) & d["doc_id"].eqNullSafe(F.col("__gone_id"))
    asked = near.filter("__maybe")
    stay = asked.join(lost, match(asked), "left_anti")
    twice = groups.filter("kept and n > 1").select(F.col("doc_id").alias("__gone_id"), F.col("text_sha256").alias("__gone"))
    if not twice.isEmpty():
        again = stay.join(twice, match(stay), "left_semi").dropDuplicates(["doc_id", "__row_digest"])
        stay = stay.join(twice, match(stay), "left_anti").unionByName(again)
    return near.filter(~F.col("__maybe")).unionByName(stay).drop("__row_digest", "__maybe")
