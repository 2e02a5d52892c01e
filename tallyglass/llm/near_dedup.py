"""MinHash near-dedup by dart throwing over weighted word shingles.

A shingle (five words) weighs as often as its text has it. Each unit of weight is a
region at which hashed darts arrive at exponential gaps; only darts of rank below a
threshold fitted to the text's total weight are thrown at all, so a long text costs one
hash per shingle and a fixed number of darts. The earliest dart of each coordinate makes
the signature: two texts agree in a coordinate as often as their weighted Jaccard
similarity says. Bands of coordinates are joined, candidates are compared, and links
become classes. Leaders and splits of large buckets only join most of their rows cheaply:
every pair of a bucket that is in different components after them is compared too.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, discard, drop_rows, in_arrow, map_texts, release, settled, staged
from .components import components
from .hashing import U, mix, word_grams, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 128
BAND = 5
#: Buckets of up to so many signatures are compared pair by pair; larger ones by leaders.
SMALL = 16
#: Large buckets that stay mixed are split so often, each time in so many ways.
DEPTHS, SPLITS = 2, 2
#: What is mixed even then is compared in full, in blocks of about so many signatures and bytes of text on each side.
BLOCK, BLOCK_BYTES = 2048, 1 << 22
#: Agreement of signatures below / above which a pair is settled without its shingles.
SURE = (0.64, 0.94)


def shingles(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every k-word shingle, lower-cased; fewer words: one shingle of all."""
    word, doc = word_hashes(texts)
    if not len(word):
        return np.zeros(0, U), np.zeros(0, np.int64)
    gram = word_grams(word, k)
    ok = doc[: len(gram)] == doc[k - 1 :] if len(gram) else np.zeros(0, bool)
    hashes, owner = gram[ok], doc[: len(gram)][ok]
    count = np.bincount(doc, minlength=len(texts))
    first = np.searchsorted(doc, np.arange(len(texts)))
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.array([np.bitwise_xor.reduce(mix(word[first[d] : first[d] + count[d]] + np.arange(1, count[d] + 1, dtype=U))) for d in short], U)
        hashes, owner = np.concatenate([hashes, own]), np.concatenate([owner, short])
    return hashes, owner


def units(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One element per unit of weight: the j-th of equal shingles of a text gets number j."""
    order = np.lexsort((hashes, owner))
    h, d = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.arange(len(h))
    j = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(h + j.astype(U) * U(0xA24BAED4963EE407)), d


def dart_signatures(element: np.ndarray, owner: np.ndarray, n: int, k: int = COORDINATES, part: np.ndarray | None = None) -> np.ndarray:
    """Signatures of n texts (n x k, uint64; 0 throughout for a text without elements).

    `element`, `owner`: hash and text of each unit region, grouped by text. `part`: how
    much of the region the text fills (up to 1; all of it if None): a dart beyond that
    does not count, which is how real weights are handled.
    """
    sign = np.zeros((n, k), U)
    weight = np.bincount(owner, part, minlength=n)
    todo = np.flatnonzero(weight > 0)
    limit = np.zeros(n)
    limit[todo] = k * (log(k) + 2) / weight[todo]
    while len(todo):
        active = np.zeros(n, bool)
        active[todo] = True
        rows = np.flatnonzero(active[owner])
        e, d = element[rows], owner[rows]
        fill = None if part is None else part[rows]
        rank, ranks, coords, ids, docs, i = np.zeros(len(e)), [], [], [], [], 0
        while len(e):
            u = mix(e + U((2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64))
            rank = rank - np.log(((u >> U(11)).astype(float) + 1) * 2.0**-53)
            keep = rank < limit[d]
            e, d, rank, u = e[keep], d[keep], rank[keep], u[keep]
            fill = None if fill is None else fill[keep]
            v = mix(u ^ U(0xD1B54A32D192ED03))
            hit = slice(None) if fill is None else (mix(v + U(1)) >> U(11)).astype(float) * 2.0**-53 < fill
            ranks.append(rank[hit])
            coords.append((v % U(k)).astype(np.int64)[hit])
            ids.append(v[hit] | U(1))
            docs.append(d[hit])
            i += 1
        rank, cell, got = np.concatenate(ranks), np.concatenate(docs) * k + np.concatenate(coords), np.concatenate(ids)
        order = np.lexsort((rank, cell))
        cell, got = cell[order], got[order]
        lead = np.ones(len(cell), bool)
        lead[1:] = cell[1:] != cell[:-1]
        sign[todo] = 0
        sign.reshape(-1)[cell[lead]] = got[lead]
        todo = todo[(sign[todo] == 0).any(1)]
        limit[todo] *= 2
    return sign


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _lists(rows: np.ndarray) -> pa.Array:
    flat = pa.array(rows.astype(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)


def signatures(docs: DataFrame, k: int = COORDINATES, band: int = BAND, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, full (digest of the whole signature, null without words), sig (16 bits a coordinate), bands."""
    n_bands = k // band

    def work(texts: list[str | None]) -> list[pa.Array]:
        element, owner = units(*shingles(texts, shingle))
        sign = dart_signatures(element, owner, len(texts), k)
        some = (sign != 0).any(1)
        salt = np.arange(1, k + 1, dtype=U) * U(0x9E3779B97F4A7C15)
        full = np.stack([np.bitwise_xor.reduce(mix(sign ^ salt), 1), np.bitwise_xor.reduce(mix(sign + salt), 1)], 1)
        grouped = sign[:, : n_bands * band].reshape(len(texts), n_bands, band)
        key = np.zeros((len(texts), n_bands), U) + np.arange(1, n_bands + 1, dtype=U)
        for i in range(band):
            key = mix(key ^ grouped[:, :, i])
        mask = pa.array(~some)
        blank = lambda x: pa.compute.if_else(mask, pa.scalar(None, x.type), x)
        return [blank(_binary(full)), blank(_binary((sign >> U(40)).astype(np.uint16))), blank(_lists(key.view(np.int64)))]

    import pyarrow.compute  # noqa: F401

    return map_texts(docs, lambda: work, "full binary, sig binary, bands array<bigint>")


def _pairs(buckets: DataFrame, small: int) -> DataFrame:
    """Candidate pairs a < b from (key, rep, comp), only between components.

    All pairs of a small bucket; in a large one each row with its first.
    """
    lead = F.struct("rep", "comp")
    count = staged(
        buckets.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.min(lead).alias("lead"),
        ).filter("n > 1 and lo <> hi").drop("lo", "hi"),
        "buckets",
    )
    few = buckets.join(count.filter(F.col("n") <= small).select("key"), "key").groupBy("key").agg(F.array_sort(F.collect_list(lead)).alias("all"))
    inner = F.flatten(F.transform("all", lambda x, i: F.transform(F.filter(F.slice("all", i + 2, small), lambda y: y["comp"] != x["comp"]), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))))
    close = few.select(F.explode(inner).alias("p")).select("p.a", "p.b")
    many = buckets.join(count.filter(F.col("n") > small).drop("n"), "key").filter(F.col("lead.comp") != F.col("comp"))
    star = many.select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b"))
    return close.unionByName(star).distinct()


def _named(rows: DataFrame, comp: DataFrame, column: str) -> DataFrame:
    """`rows` with the component of a column's signatures (their own name if they have no link yet)."""
    names = comp.select(F.col("node").alias(column), F.col("comp").alias("__comp"))
    return rows.join(names, column, "left").withColumn(f"comp_{column}", F.coalesce("__comp", column)).drop("__comp")


def _finer(buckets: DataFrame, sigs: DataFrame, comp: DataFrame, small: int, depth: int) -> DataFrame:
    """Large buckets that hold several components yet, split by three further coordinates, in SPLITS ways.

    Texts above the threshold share three given coordinates more often than not, texts
    that only have a passage in common rarely do. Which coordinates, the bucket's key says.
    """
    named = _named(buckets.drop("comp"), comp, "rep").withColumnRenamed("comp_rep", "comp")
    mixed = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter((F.col("n") > small) & (F.col("lo") != F.col("hi")))
    rows = named.join(mixed.select("key", "lo"), "key").join(sigs.select("rep", "sig"), "rep")
    groups = COORDINATES // 3
    first = lambda t: F.pmod(F.xxhash64("key", F.lit(depth * SPLITS + t)), F.lit(groups)) * 6 + 1
    keys = F.array(*[F.xxhash64("key", F.lit(t), F.substring("sig", first(t).cast("int"), F.lit(6))) for t in range(SPLITS)])
    rows = staged(rows.select("rep", "comp", (F.col("comp") == F.col("lo")).alias("main"), keys.alias("keys")), "mixed")
    # Rows of a bucket's main component matter only where a row of another one meets them.
    apart = rows.filter("not main").select("rep", "comp", F.explode("keys").alias("key"))
    wanted = staged(apart.select("key").distinct(), "wanted")
    for t in range(SPLITS):
        own = rows.filter("main").select("rep", "comp", F.col("keys")[t].alias("key"))
        apart = apart.unionByName(own.join(wanted, "key", "left_semi"))
    return staged(apart, "finer")


def _shared(left: np.ndarray, right: np.ndarray, texts: pa.ChunkedArray) -> np.ndarray:
    """Weighted Jaccard similarity of the texts at places left[i] and right[i]; equal left ones stand together."""
    need = np.unique(np.concatenate([left, right]))
    found, sizes = [], []
    for batch in pa.table({"text": texts.take(pa.array(need))}).to_batches():
        for part in by_bytes(batch, 0):
            element, owner = units(*shingles(part.column(0).to_pylist()))
            found.append(element)
            sizes.append(np.bincount(owner, minlength=part.num_rows))
    ids = np.unique(np.concatenate(found), return_inverse=True)[1]
    size = np.concatenate(sizes)
    start = np.cumsum(size) - size
    mark = np.zeros(len(ids), bool)
    x, y, both = np.searchsorted(need, left), np.searchsorted(need, right), np.zeros(len(left))
    cuts = [0, *(np.flatnonzero(np.diff(left)) + 1).tolist(), len(left)]
    for lo, hi in zip(cuts, cuts[1:]):
        own, others = ids[start[x[lo]] : start[x[lo]] + size[x[lo]]], y[lo:hi]
        before = np.cumsum(size[others]) - size[others]
        mark[own] = True
        both[lo:hi] = np.add.reduceat(mark[ids[np.repeat(start[others] - before, size[others]) + np.arange(size[others].sum())]].astype(int), before)
        mark[own] = False
    return both / (size[x] + size[y] - both)


def _block(rows: pa.Table, threshold: float) -> pa.Table:
    """The links of a block between components: pairs that first meet in this bucket and reach the threshold."""
    rep, comp, key, left, apart = (rows.column(c).to_numpy() for c in ("rep", "comp", "key", "left", "apart"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(len(rep), -1)
    bands = pc.list_flatten(rows.column("bands")).to_numpy().reshape(len(rep), -1)
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    a, b, est = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    right = np.ascontiguousarray(sig[y])
    for i in x.tolist():
        # Two rows apart from the main component meet twice: once as either side.
        meets = (comp[y] != comp[i]) & (~apart[y] | (rep[y] > rep[i]))
        share = (right == sig[i]).mean(1)
        hit = np.flatnonzero(meets & (share >= SURE[0]))
        # In an earlier band that they share, they were compared or were of one component.
        hit = hit[bands[i][(bands[y[hit]] == bands[i]).argmax(1)] == key[i]]
        a.append(np.full(len(hit), i))
        b.append(y[hit])
        est.append(share[hit])
    a, b, est = np.concatenate(a), np.concatenate(b), np.concatenate(est)
    linked = est >= SURE[1]
    if not linked.all():
        linked[~linked] = _shared(a[~linked], b[~linked], rows.column("text")) >= threshold
    a, b = rep[a[linked]], rep[b[linked]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _rest(buckets: DataFrame, sigs: DataFrame, texts: DataFrame, comp: DataFrame, threshold: float, small: int, block: int) -> DataFrame:
    """The links (a, b) of all large buckets between components.

    Each row apart from the bucket's largest component meets all rows of the others.
    Both sides are dealt in blocks, by rows and by bytes, so that no task holds a whole
    bucket; pairs are compared inside their block, and only links leave it.
    """
    sizes = texts.select("rep", F.octet_length("text").cast("long").alias("bytes"))
    named = _named(buckets.drop("comp").join(sizes, "rep"), comp, "rep").withColumnRenamed("comp_rep", "comp")
    parts = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.ceil(F.greatest(n / block, size / BLOCK_BYTES))
    total, main = F.col("n"), F.col("main.n")
    mixed = staged(
        parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "comp", "bytes")).alias("main")).filter((total > small) & (total > main))
        .select("key", F.col("main.comp").alias("main"), blocks(total, F.col("bytes")).alias("all"), blocks(total - main, F.col("bytes") - F.col("main.bytes")).alias("few")),
        "mixed",
    )
    rows = named.join(mixed, "key").withColumn("apart", F.col("comp") != F.col("main"))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ("key", "rep", "comp", "apart")
    left = rows.filter("apart").select(*kept, F.lit(True).alias("left"), own("few").alias("i"), each("all").alias("j"))
    right = rows.select(*kept, F.lit(False).alias("left"), each("few").alias("i"), own("all").alias("j"))
    dealt = staged(left.unionByName(right), "dealt")
    full = dealt.join(sigs.select("rep", "sig", "bands").join(texts, "rep"), "rep")
    out = staged(full.groupBy("key", "i", "j").applyInArrow(lambda rows: _block(rows, threshold), "a bigint, b bigint"), "rest")
    discard(mixed, dealt)
    return out


def _joined(comp: DataFrame, more: DataFrame) -> DataFrame:
    """The components after further links."""
    joint = _named(_named(more, comp, "a"), comp, "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    merged = components(joint).select(F.col("node").alias("comp"), F.col("comp").alias("next"))
    ends = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = comp.unionByName(ends.join(comp, "node", "left_anti").select("node", F.col("node").alias("comp")))
    return staged(known.join(merged, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "labels")


def _jaccard(iterator):
    """Weighted Jaccard similarity of the two texts of each row."""
    for batch in iterator:
        values = []
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            n = part.num_rows
            texts = part.column(2).to_pylist() + part.column(3).to_pylist()
            element, owner = units(*shingles(texts))
            cuts = np.searchsorted(owner, np.arange(2 * n + 1))
            for i in range(n):
                x, y = element[cuts[i] : cuts[i + 1]], element[cuts[n + i] : cuts[n + i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                values.append(both / max(1, len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=["a", "b", "sim"])


def _agree(batches):
    """How often the signatures of each pair agree."""
    for batch in batches:
        n = batch.num_rows
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(n, -1) if n else np.zeros((0, 1)) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(1) if n else np.zeros(0))], names=["a", "b", "est"])


def _scored(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs that their signatures do not rule out, with the estimate `est`."""
    left = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    est = in_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), _agree, "a bigint, b bigint, est double")
    out = staged(est.filter(F.col("est") >= SURE[0]), "scored")
    release(pairs.sparkSession)
    return out


def _verified(scored: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The scored pairs whose similarity reaches the threshold: by signature where that is clear, else by their shingles."""
    sure = scored.filter(F.col("est") >= SURE[1]).select("a", "b")
    close = (
        scored.filter(F.col("est") < SURE[1]).select("a", "b")
        .join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )
    exact = in_arrow(close, _jaccard, "a bigint, b bigint, sim double")
    out = staged(sure.unionByName(exact.filter(F.col("sim") >= threshold).select("a", "b")), "links")
    release(scored.sparkSession)
    return out


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, small: int = SMALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, class_size.

    Texts linked by a similarity of at least `threshold`, directly or over others, form
    a class, named by its smallest doc_id. `n_links` counts the verified links of the
    document's signature to others. Texts without words, and rows without an id, are
    classes of their own. Rows that repeat a doc_id share its class.
    """
    spark = docs.sparkSession
    sigs = staged(signatures(docs), "signatures")
    known = sigs.filter(F.col("full").isNotNull() & F.col("doc_id").isNotNull())
    # Texts of equal signatures (their similarity is close to 1) go on as one.
    reps = staged(
        known.groupBy("full").agg(F.min("doc_id").alias("rep")), "representatives"
    )
    one = staged(
        known.join(reps.select(F.col("rep").alias("doc_id"), F.col("full").alias("f2")), "doc_id").filter("full = f2")
        .groupBy("doc_id").agg(F.min(F.struct("full", "sig", "bands")).alias("least")).select("doc_id", "least.*").select(F.col("doc_id").alias("rep"), "sig", "bands"),
        "ones",
    )
    buckets = staged(one.select("rep", F.col("rep").alias("comp"), F.explode("bands").alias("key")), "bands")
    first_buckets = buckets
    scored = _scored(_pairs(buckets, small), one)
    # The texts that this and the finer rounds may compare: read once.
    large = buckets.join(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > small).select("key"), "key").select("rep")
    asked = scored.filter(F.col("est") < SURE[1]).select(F.explode(F.array("a", "b")).alias("rep")).unionByName(large).distinct()
    texts = staged(docs.select(F.col("doc_id").alias("rep"), "text").join(asked, "rep", "left_semi").dropDuplicates(["rep"]), "texts")
    release(spark)
    edges = _verified(scored, texts, threshold)
    comp = components(edges)
    for depth in range(DEPTHS):
        finer = _finer(buckets, one, comp, small, depth)
        if not finer.limit(1).count():
            break
        more = _verified(_scored(_pairs(finer, small), one), texts, threshold)
        buckets = finer
        if more.limit(1).count():
            comp = _joined(comp, more)
            edges = staged(edges.unionByName(more).distinct(), "links")
    more = _rest(first_buckets, one, texts, comp, threshold, small, BLOCK)
    if more.limit(1).count():
        comp = _joined(comp, more)
        edges = staged(edges.unionByName(more).distinct(), "links")
    discard(more, texts, one, first_buckets, scored)
    links = edges.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    member = (
        sigs.select("doc_id", "full").join(reps, "full", "left")
        .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .join(links, "rep", "left")
        .select("doc_id", F.coalesce("comp", "rep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )
    member = staged(member, "members")
    discard(sigs, reps)
    sizes = member.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    own = F.col("class_id").isNull()
    return member.join(sizes, "class_id", "left").select("doc_id", "class_id", "n_links", F.when(own, 1).otherwise(F.col("class_size")).alias("class_size"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of every class, the one with the smallest doc_id, all columns kept."""
    other = ~F.col("class_id").eqNullSafe(F.col("doc_id"))
    return drop_rows(docs, settled(lambda: near_classes(docs, threshold).filter(other).select("doc_id").distinct(), "gone"))
