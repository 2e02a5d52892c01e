"""Benchmark decontamination with a distributed positional inverted index.

The index holds one posting (term, doc_id, tag, pos) for every place where a training
text has a word that some test item uses, and one that closes each text and tells its
length. A test phrase looks up the list of its rarest term (by postings), then that of
its second rarest, and keeps the starts on which the offset-adjusted lists agree; the
remaining terms are intersected likewise. What is left are exact phrase matches.
Proximity matches intersect the lists within a distance instead. Everything is built
from DataFrame functions. `tag` tells rows of one doc_id apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, drop_rows, same, settled, staged, text_tag

PHRASE = 10
#: All terms of a phrase within so many consecutive words are a proximity match.
DISTANCE = 20
#: Candidate documents are marked in so many buckets, the bound of a broadcast table.
BUCKETS = 1 << 16
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII that parts words: all but letters and digits.
_PARTS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: The term of the posting behind a text's last word.
_END = -1
_ROW = ["doc_id", "tag"]


def words(text: str = "text") -> Column:
    """Runs of ASCII letters (lower-cased), digits and all that is not ASCII; far cheaper than a regular expression."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), _UP + _PARTS, _LOW + " " * len(_PARTS))
    return F.array_remove(F.split(low, " "), "")


def phrases(bench: DataFrame, size: int = PHRASE, step: int = 1) -> tuple[DataFrame, DataFrame]:
    """Distinct phrases (phrase, n, terms) of the items and the items of each (phrase, item_id).

    Phrases begin at every `step`-th word; the last one ends with the item. An item of
    fewer than `size` words, but not none, is one phrase.
    """
    item = bench.select(F.col("item_id").cast("string").alias("item_id"), words().alias("w")).filter("size(w) > 0")
    last = F.greatest(F.lit(1), F.size("w") - (size - 1))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, F.lit(step)), F.array(last)))
    cut = item.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("terms"))
    key = F.sha2(F.array_join("terms", " "), 256)
    owned = staged(cut.select(key.alias("phrase"), "terms", "item_id").distinct(), "phrases")
    distinct = owned.groupBy("phrase").agg(F.first("terms").alias("terms")).withColumn("n", F.size("terms"))
    return distinct, owned.select("phrase", "item_id").distinct()


def build_vocabulary(*distinct: DataFrame) -> DataFrame:
    """Stored (word, term) of the phrases' words, and the term that closes a text."""
    spark = distinct[0].sparkSession
    some = distinct[0].select(F.explode("terms").alias("word"))
    for more in distinct[1:]:
        some = some.unionByName(more.select(F.explode("terms").alias("word")))
    numbered = some.distinct().withColumn("term", F.monotonically_increasing_id())
    return staged(numbered.unionByName(spark.createDataFrame([("", _END)], numbered.schema)), "vocabulary")


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Stored postings (term, doc_id, tag, pos) of the vocabulary, whole texts, in one pass over them.

    The vocabulary is that of the test items: Spark broadcasts it where it is below
    spark.sql.autoBroadcastJoinThreshold and shuffles otherwise.
    """
    tokens = docs.select("doc_id", text_tag().alias("tag"), F.posexplode(F.concat(words(), F.array(F.lit("")))).alias("pos", "word"))
    return staged(tokens.join(vocabulary, "word").select("term", *_ROW, "pos"), "postings")


def lengths(index: DataFrame) -> DataFrame:
    """(doc_id, tag, n_words), one row per row of the documents."""
    return index.filter(F.col("term") == _END).select(*_ROW, F.col("pos").cast("long").alias("n_words"))


def _numbered(distinct: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The phrases with the numbers of their terms."""
    return staged(
        distinct.select("phrase", F.xxhash64("phrase").alias("phrase_id"), "n", F.posexplode("terms").alias("off", "word"))
        .join(vocabulary, "word")
        .groupBy("phrase", "phrase_id", "n")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("off", "term"))), lambda x: x["term"]).alias("ids")),
        "phrase_ids",
    )


def _ranked(counts: DataFrame, numbered: DataFrame) -> DataFrame:
    """Stored (phrase_id, n, off, term, rank) of phrases all of whose terms have postings; rank 1: the rarest."""
    each = numbered.select("phrase_id", "n", F.posexplode("ids").alias("off", "term"))
    rank = F.row_number().over(Window.partitionBy("phrase_id").orderBy("postings", "term", "off"))
    # A phrase with a term that has no posting matches nowhere.
    scored = each.join(counts, "term", "left").withColumn("rank", rank)
    dead = scored.filter("postings is null").select("phrase_id").distinct()
    return staged(scored.join(dead, "phrase_id", "left_anti").drop("postings"), "anchors")


def _counts(index: DataFrame) -> DataFrame:
    """Postings of each term. Stored, so that Spark can split a hot term in the join behind."""
    return staged(index.groupBy("term").agg(F.count(F.lit(1)).alias("postings")), "counts")


def _candidates(index: DataFrame, anchors: DataFrame, rank: int) -> DataFrame:
    of = anchors.filter(F.col("rank") == rank).select("term", "phrase_id", "off")
    return index.join(of, "term").select("phrase_id", *_ROW, (F.col("pos") - F.col("off")).alias("start"))


def _marked(index: DataFrame, found: DataFrame) -> DataFrame:
    """The postings of documents that may be in `found`."""
    bucket = F.pmod(F.xxhash64(*_ROW), F.lit(BUCKETS))
    marked = found.select(bucket.alias("bucket")).distinct()  # at most BUCKETS rows of one number
    return index.withColumn("bucket", bucket).join(F.broadcast(marked), "bucket", "left_semi").drop("bucket")


def _exact(index: DataFrame, anchors: DataFrame, numbered: DataFrame) -> DataFrame:
    """All exact matches (phrase, doc_id, tag, start, n), stored."""
    key = ["phrase_id", *_ROW, "start"]
    one = anchors.filter("n = 1").select("phrase_id")
    tagged = _candidates(index, anchors, 1).withColumn("r", F.lit(1)).unionByName(_candidates(index, anchors, 2).withColumn("r", F.lit(2)))
    agreed = tagged.groupBy(*key).agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    # Starts on which the lists of the two rarest terms agree (one-word phrases: all).
    both = staged(agreed.filter("lo = 1 and hi = 2").select(*key).unionByName(agreed.join(one, "phrase_id", "left_semi").select(*key)), "two")
    rest = anchors.filter("rank > 2").select("phrase_id", "off", "term")
    need = both.join(rest, "phrase_id").select(*key, (F.col("start") + F.col("off")).alias("pos"), "term")
    cells = need.select(*_ROW, "pos", "term").distinct()
    met = same(_marked(index, both), cells, [*_ROW, "pos", "term"], "left_semi").distinct()
    hits = same(need, met, [*_ROW, "pos", "term"]).groupBy(*key).agg(F.count(F.lit(1)).alias("found"))
    counted = same(both, hits, key, "left").join(numbered.select("phrase_id", "phrase", "n"), "phrase_id")
    matches = staged(counted.filter(F.coalesce("found", F.lit(0)) == F.greatest(F.lit(0), F.col("n") - 2)).select("phrase", *_ROW, "start", "n"), "matches")
    discard(both)
    return matches


def _near(index: DataFrame, anchors: DataFrame, numbered: DataFrame, distance: int) -> DataFrame:
    """(phrase, doc_id, tag), stored: some `distance` consecutive words hold all terms of the phrase.

    Lists meet by buckets of `distance` positions around the places of the rarest term;
    what is gathered about a place is bounded, as a position has one word.
    """
    terms = anchors.groupBy("phrase_id", "term").agg(F.min("rank").alias("least"))
    order = F.row_number().over(Window.partitionBy("phrase_id").orderBy("least"))
    terms = staged(terms.withColumn("rank", order).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("phrase_id"))).drop("least"), "terms")
    key = ["phrase_id", *_ROW, "a"]
    cell = lambda c: F.floor(F.col(c) / distance)
    around = F.explode(F.array(*[cell("a") + i for i in (-1, 0, 1)]))
    first = index.join(terms.filter("rank = 1").select("term", "phrase_id", "k"), "term").select("phrase_id", *_ROW, "k", F.col("pos").alias("a"))
    close = F.abs(F.col("pos") - F.col("a")) < distance
    second = index.join(terms.filter("rank = 2").select("term", "phrase_id"), "term").select("phrase_id", *_ROW, "pos", cell("pos").alias("cell"))
    two = same(first.filter("k > 1").withColumn("cell", around), second, ["phrase_id", *_ROW, "cell"]).filter(close).select(*key, "k").distinct()
    two = staged(two, "near_two")
    rest = two.select(*key, "k", around.alias("cell")).join(terms.select("phrase_id", "term"), "phrase_id")
    lists = _marked(index, two).select("term", *_ROW, "pos", cell("pos").alias("cell"))
    met = same(rest, lists, ["term", *_ROW, "cell"]).filter(close).select(*key, "k", "pos", "term").distinct()
    places = met.groupBy(*key, "k").agg(F.collect_list(F.struct("pos", "term")).alias("at"))  # under 2 * distance places
    whole = F.exists("at", lambda s: F.size(F.array_distinct(F.transform(F.filter("at", lambda x: x["pos"].between(s["pos"], s["pos"] + distance - 1)), lambda x: x["term"]))) == F.col("k"))
    found = places.filter(whole).select("phrase_id", *_ROW).unionByName(first.filter("k = 1").select("phrase_id", *_ROW)).distinct()
    out = staged(found.join(numbered.select("phrase_id", "phrase"), "phrase_id").select("phrase", *_ROW), "near")
    discard(terms, two)
    return out


def phrase_matches(docs: DataFrame, bench: DataFrame, size: int = PHRASE) -> tuple[DataFrame, DataFrame]:
    """All exact matches (phrase, doc_id, tag, start, n) and the items of the phrases (phrase, item_id)."""
    distinct, owners = phrases(bench, size)
    vocabulary = build_vocabulary(distinct)
    index = build_index(docs, vocabulary)
    numbered = _numbered(distinct, vocabulary)
    matches = _exact(index, _ranked(_counts(index), numbered), numbered)
    discard(index)
    return matches, owners


def proximity_matches(docs: DataFrame, bench: DataFrame, distance: int = DISTANCE, size: int = PHRASE) -> tuple[DataFrame, DataFrame]:
    """(phrase, doc_id, tag) of proximity matches, and the items of the phrases (phrase, item_id).

    Phrases here are the item's consecutive stretches of `size` words (and its last
    `size` words). One matches where some `distance` consecutive words of a text hold
    all of its distinct words, in any order.
    """
    distinct, owners = phrases(bench, size, size)
    vocabulary = build_vocabulary(distinct)
    index = build_index(docs, vocabulary)
    numbered = _numbered(distinct, vocabulary)
    near = _near(index, _ranked(_counts(index), numbered), numbered, distance)
    discard(index)
    return near, owners


def decontaminate(docs: DataFrame, bench: DataFrame, size: int = PHRASE, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    `n_near` counts the items of which some phrase has a proximity match (see
    `proximity_matches`). Null texts have no words. Rows that repeat a doc_id are
    documents of their own, also null ids. Items with null text match nothing. Only
    doc_id, text and item_id are read. An empty input gives an empty result.
    """
    distinct, owners = phrases(bench, size)
    apart, apart_owners = phrases(bench, size, size)
    vocabulary = build_vocabulary(distinct)
    index = build_index(docs, vocabulary)
    counts = _counts(index)
    numbered, apart_numbered = _numbered(distinct, vocabulary), _numbered(apart, vocabulary)
    matches = _exact(index, _ranked(counts, numbered), numbered)
    near = _near(index, _ranked(counts, apart_numbered), apart_numbered, distance)
    base = staged(lengths(index), "lengths")
    discard(index)
    cover = matches.select(*_ROW, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    hit = cover.groupBy(*_ROW).agg(F.count(F.lit(1)).alias("n_hit"))
    items = (
        matches.select(*_ROW, "phrase").distinct().join(owners, "phrase")
        .groupBy(*_ROW).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    close = near.join(apart_owners, "phrase").select(*_ROW, "item_id").distinct().groupBy(*_ROW).agg(F.count(F.lit(1)).alias("n_near"))
    rows = hit.select(*_ROW).unionByName(close.select(*_ROW)).distinct()
    found = staged(same(same(same(rows, hit, _ROW, "left"), items, _ROW, "left"), close, _ROW, "left"), "found")
    zero = F.lit(0).cast("long")
    return same(base, found, _ROW, "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce(F.when(F.col("items").isNotNull(), F.size("items")).cast("long"), zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        F.coalesce("n_near", zero).alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, size: int = PHRASE) -> DataFrame:
    """The rows of `docs` in which no phrase of an item occurs, all columns kept."""
    hit = settled(lambda: phrase_matches(docs, bench, size)[0].select(*_ROW).distinct(), "hit")
    return drop_rows(docs, hit)
