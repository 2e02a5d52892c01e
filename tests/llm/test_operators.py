import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyglass.llm.chain_dedup import chains, common_words, repeated_passages, runs
from tallyglass.llm.chain_dedup import _selected as seeds_of
from tallyglass.llm.decontaminate import decontaminate, proximity_matches
from tallyglass.llm.exact_dedup import exact_groups
from tallyglass.llm.language_id import identify
from tallyglass.llm.mixing import capped_shares, mix
from tallyglass.llm import near_dedup
from tallyglass.llm.near_dedup import near_classes
from tallyglass.llm.secrets import guess_cost, scan, scan_secrets
from tallyglass.llm.suffix_dedup import cut_repeats
from tallyglass.llm.token_counts import BLANK, Counter as Tokens, count_tokens
from tallyglass.llm.toxicity import toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, digest string, score string, n bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, source if i % 3 else None, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)


def prose(n, seed):
    return " ".join(f"{WORDS[(i * seed + i * i) % 20]}{(i * 7 + seed) % 31}" for i in range(n))


EDGE = [None, "", " ", "a", prose(300, 3), prose(300, 3), prose(80, 5), "x" * 5000, "é漢字😀 " * 50]
OPERATORS = {
    "1": cut_repeats, "2": identify, "3": scan_secrets, "4": exact_groups, "5": repeated_passages, "6": near_classes,
    "7": lambda d: decontaminate(d, d.selectExpr("doc_id AS item_id", "text")), "8": count_tokens,
    "9": lambda d: toxicity(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic")), "10": mix,
}


@pytest.mark.parametrize("n", OPERATORS)
def test_edges(spark, n):
    rows = docs(spark, EDGE).unionByName(spark.createDataFrame([(None, "no id", None, None, None, None, None), (4, prose(300, 3), "en", "a", "x", "y", 1)], SCHEMA))
    assert OPERATORS[n](rows).count() == len(EDGE) + 2
    assert OPERATORS[n](rows.limit(0)).count() == 0


def test_suffix_dedup_brute(spark):
    texts = ["abcabc" * 9, "zz" + "abcabc" * 4, "unique text here", None, prose(40, 3), "q" + prose(30, 3)]
    n, counts = 20, Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        counts.update(b[i : i + n] for i in range(len(b) - n + 1))
    for r in cut_repeats(docs(spark, texts), n, 4).collect():
        b, gone = raw[r.doc_id], set()
        for i in range(len(b) - n + 1):
            if counts[b[i : i + n]] > 1:
                gone.update(range(i, i + n))
        assert (r.n_bytes, r.n_removed) == (len(b), len(gone))
        assert r.kept_sha256 == hashlib.sha256(bytes(c for i, c in enumerate(b) if i not in gone)).hexdigest()


def test_exact_and_near(spark):
    base = prose(400, 3).split()
    near = [*base]
    near[50] = "changed"
    texts = [" ".join(base), "\n ".join(base), " ".join(near), prose(400, 11)]
    assert [r.keep_id for r in exact_groups(docs(spark, texts)).orderBy("doc_id").collect()] == [0, 0, 2, 3]
    assert [r.class_id for r in near_classes(docs(spark, texts)).orderBy("doc_id").collect()] == [0, 0, 0, 3]


def test_large_group_of_near_copies(spark):
    base = prose(300, 3).split()
    texts = []
    for i in range(60):
        w = [*base]
        w[5 * i] = f"edit{i}"
        texts.append(" ".join(w))
    assert {r.class_id for r in near_classes(docs(spark, texts)).collect()} == {0}


def test_rows_of_mixed_buckets_are_joined_with_them_once(spark, monkeypatch):
    buckets = spark.createDataFrame([(1, r, r) for r in range(4)] + [(2, 7, 7)], "key bigint, rep bigint, comp bigint")
    sigs = spark.createDataFrame([(r, bytes(256)) for r in range(8)], "rep bigint, sig binary")
    comp = spark.createDataFrame([(0, 0), (1, 0)], "node bigint, comp bigint")
    plans, staged = {}, near_dedup.staged
    monkeypatch.setattr(near_dedup, "staged", lambda df, tag: plans.setdefault(tag, df._jdf.queryExecution().optimizedPlan().toString()) and staged(df, tag))
    finer = near_dedup._finer(buckets, sigs, comp, 2, 0)
    assert sorted((r.rep, r.comp) for r in finer.collect()) == [(r, c) for r, c in enumerate((0, 0, 2, 3)) for _ in range(2)]
    assert plans["mixed"].count("Join Inner, (key#") == 1


def test_pairs_of_a_template_family(spark):
    # All texts are near one template, but only partners reach 0.8 with each other.
    import random

    draw, texts = random.Random(7), []
    base = prose(400, 3).split()
    for i in range(40):
        w, shared = [*base], draw.sample(range(80), 3)
        own = [draw.sample([p for p in range(80) if p not in shared], 4) for _ in range(2)]
        for k in range(2):
            v = [*w]
            for p in shared:
                v[5 * p + 2] = f"both{i}"
            for p in own[k]:
                v[5 * p + 2] = f"own{i}x{k}"
            texts.append(" ".join(v))

    def jaccard(x, y):
        both = sum((x & y).values())
        return both / (sum(x.values()) + sum(y.values()) - both)

    grams = [Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in map(str.split, texts)]
    links = [(i, j) for i in range(80) for j in range(i) if jaccard(grams[i], grams[j]) >= 0.8]
    name = list(range(80))
    for i, j in links:
        hi, lo = max(name[i], name[j]), min(name[i], name[j])
        name = [lo if n == hi else n for n in name]
    assert len(set(name)) > 20
    assert [r.class_id for r in near_classes(docs(spark, texts), small=1).orderBy("doc_id").collect()] == name


def test_passages(spark):
    shared = prose(70, 5)
    fuzzy = shared.split()
    fuzzy[30] = "other"
    got = {r.doc_id: r for r in repeated_passages(docs(spark, [prose(200, 3) + " " + shared, shared + " " + prose(150, 11), " ".join(fuzzy), prose(200, 13)])).collect()}
    assert {got[i].class_id for i in (0, 1, 2)} == {0} and got[3].n_passages == 0
    assert common_words(*[np.array(x) for x in ([1, 2, 3, 4], [2, 9, 4])]) == 2


def invented(draw, n):
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))


def test_passages_between_quotes(spark):
    # 100 and 101 share 120 words, pieces of which stand in documents with smaller and larger ids too.
    draw = random.Random(5)
    shared = invented(draw, 120).split()
    rows = [(k, f"{invented(draw, 90)} {' '.join(shared)} {invented(draw, 90)}") for k in (100, 101)]
    for base in (0, 200):
        rows += [(base + i, f"{invented(draw, 60)} {' '.join(shared[24 * i : 24 * i + 24])} {invented(draw, 60)}") for i in range(5)]
    # 300 and 301 share two passages, 300 and 80 words long.
    one, two = invented(draw, 300), invented(draw, 80)
    rows += [(k, f"{invented(draw, 50)} {one} {invented(draw, 100)} {two} {invented(draw, 50)}") for k in (300, 301)]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100].class_id == got[101].class_id == 100 and got[100].n_links == 1 and got[100].n_words >= 110
    assert got[301].class_id == 300 and got[301].n_passages == 2 and got[301].n_words >= 365
    assert all(got[i].n_links == 0 for i in got if i < 100 or 200 <= i < 300)


def test_fuzzy_passages_are_found(spark):
    # Recall against what was planted: passages of 80 words, every 10th of them changed, and some words left out.
    draw, rows = random.Random(9), []
    for i in range(40):
        w = invented(draw, 80).split()
        v = [invented(draw, 1) if k % 10 == i % 10 else x for k, x in enumerate(w) if k != 33]
        rows += [(2 * i + k, f"{invented(draw, 70)} {' '.join(x)} {invented(draw, 70)}") for k, x in enumerate((w, v))]
    rows += [(1000 + i, invented(draw, 200)) for i in range(20)]
    got = {r.doc_id: r.class_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(40)) >= 36
    assert all(got[i] == i for i in got if i >= 1000 or i % 2 == 0)


def test_passages_of_frequent_seeds(spark):
    # 500 and 501 share 60 words but one; each 20 of them, and so each seed and each two near seeds, stand in 14 texts more.
    draw = random.Random(21)
    shared = invented(draw, 60).split()
    pair = [shared[:30] + [w] + shared[31:] for w in ("one", "other")]
    rows = [(500 + k, f"{invented(draw, 80)} {' '.join(w)} {invented(draw, 80)}") for k, w in enumerate(pair)]
    rows += [(14 * i + k, f"{invented(draw, 80)} {' '.join(shared[10 * i : 10 * i + 20])} {invented(draw, 80)}") for i in range(5) for k in range(14)]
    # A family of 30 texts, each with its own words at every 12th place: all pairs are links.
    base = invented(draw, 96).split()
    rows += [(1000 + k, f"{invented(draw, 60)} {' '.join(invented(draw, 1) if i % 12 == 5 else w for i, w in enumerate(base))} {invented(draw, 60)}") for k in range(30)]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[501].class_id == 500 and got[500].n_links == got[501].n_links == 1 and 55 <= got[500].n_words <= 66
    assert all(got[i].class_id == i and got[i].n_links == 0 for i in got if i < 500)
    assert all(got[1000 + k].class_id == 1000 and got[1000 + k].n_links == 29 for k in range(30))


def test_passages_beside_bad_gaps(spark):
    # 55 words in common, then 50 others, then 16 in common: the chain over both agrees too little, its first part wholly.
    draw, rows = random.Random(22), []
    one, two = invented(draw, 55), invented(draw, 16)
    rows = [(k, f"{invented(draw, 70)} {one} {invented(draw, 50)} {two} {invented(draw, 70)}") for k in (7, 8)]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[8].class_id == 7 and got[8].n_links == 1 and 50 <= got[8].n_words <= 60


def test_seeds_whatever_stands_beside(spark):
    # Places are looked up again in other batches: a text has the same seeds there.
    draw = random.Random(23)
    texts = [invented(draw, n) for n in (200, 40, 12, 90, 3)]
    own, pos, seed, *_ = seeds_of(texts)
    for i, text in enumerate(texts):
        _, alone, same, *_ = seeds_of([text])
        assert pos[own == i].tolist() == alone.tolist() and seed[own == i].tolist() == same.tolist()


def test_families_of_near_copies_shuffle_little(spark):
    # 30 texts with every 15th word their own: 435 links, of 26 gaps each.
    draw = random.Random(24)
    base = invented(draw, 400).split()
    rows = [(k, " ".join(invented(draw, 1) if i % 15 == 5 else w for i, w in enumerate(base))) for k in range(30)]
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    known = written()
    got = repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.class_id == 0 and r.n_links == 29 for r in got)
    assert sum(n for stage, n in written().items() if stage not in known) < 22 * sum(len(t) for _, t in rows)


def test_chains_are_brute_force():
    draw = np.random.default_rng(5)
    for _ in range(60):
        x, y, n = runs(*draw.integers(0, 200, (2, 40)), draw.integers(5, 12, 40))
        assert len(set(zip((y - x).tolist(), x.tolist(), strict=True))) == len(x)
        best = []
        for i in range(len(x)):
            before = [best[j] - 0.1 * (x[i] + y[i] - x[j] - y[j] - 2 * n[j]) for j in range(len(x)) if x[j] + n[j] - 4 <= x[i] and y[j] + n[j] - 4 <= y[i] and j < i]
            best.append(n[i] + max([0.0, *before]))
        found = chains(x, y, n, reach=10**6)
        assert sorted(k for c in found for k in c) == list(range(len(x)))
        assert abs(best[found[0][-1]] - max(best)) < 1e-9
    first, second = np.arange(0, 600, 6), np.arange(700, 800, 6)
    x, y = np.r_[first, second], np.r_[first, second + 3]
    assert [(a.tolist(), b.tolist(), c.tolist()) for a, b, c in [runs(x, y, np.full(len(x), 6))]] == [([0, 700], [0, 703], [600, 102])]
    assert sorted(chains(*runs(x, y, np.full(len(x), 6)))) == [[0], [1]]


def test_decontaminate(spark):
    item = prose(14, 7)
    texts = [prose(60, 3), prose(20, 3) + " " + " ".join(item.split()[:11]) + " end", "short one", None]
    bench = spark.createDataFrame([("i1", item), ("i2", "Short ONE"), ("i3", None), ("i4", "")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate(docs(spark, texts), bench).collect()}
    assert [(got[i].n_hit, got[i].n_items) for i in range(4)] == [(0, 0), (11, 1), (2, 1), (0, 0)]
    assert got[2].items_sha256 == hashlib.sha256(b"i2").hexdigest()


def test_proximity_is_brute_force(spark):
    import random

    draw = random.Random(3)
    texts = [" ".join(draw.choice(WORDS[:9]) for _ in range(draw.randrange(0, 60))) for _ in range(40)]
    items = [" ".join(draw.choice(WORDS[:7]) for _ in range(n)) for n in (1, 3, 4, 6, 7, 4, 5)]
    bench = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string")
    found, owners = proximity_matches(docs(spark, texts), bench, 8, 4)
    want = set()
    for d, text in enumerate(texts):
        w = text.split()
        for k, item in enumerate(items):
            v = item.split()
            last = max(0, len(v) - 4)
            if any(set(v[s : s + 4]) <= set(w[a : a + 8]) for s in {*range(0, last + 1, 4), last} for a in range(len(w))):
                want.add((d, f"i{k}"))
    assert {(r.doc_id, r.item_id) for r in found.join(owners, "phrase").collect()} == want
    assert 0 < len(want) < 200


def test_rows_of_one_id_are_apart(spark):
    rows = spark.createDataFrame([(1, "aaa"), (5, "aaa"), (5, "bbb"), (7, "ccc"), (7, "ccc"), (None, "aaa"), (None, "ddd")], "doc_id bigint, text string")
    from tallyglass.llm.exact_dedup import keep_first

    assert sorted(map(str, keep_first(rows).collect())) == sorted(map(str, rows.distinct().filter("doc_id = 1 or text > 'b'").collect()))
    # Words of two rows of one id do not form a phrase together.
    bench = spark.createDataFrame([("i", "one two three four")], "item_id string, text string")
    split = spark.createDataFrame([(1, "one x three x"), (1, "x two x four"), (2, "one two three four")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_hit) for r in decontaminate(split, bench, 4).collect()) == [(1, 0), (1, 0), (2, 4)]


def test_secrets():
    text = 'x password = "hunter2zq" AKIA' + "A1" * 8 + " " + "0a" * 12 + " token=abc secret=token:abcdefgh pwd: Zk9$wQ7!rT2x pwd: password123"
    base, spans, _ = scan(text)
    assert [k for _, k, _ in base] == [0, 1, 2]
    assert any(k == 3 and text[a:b] == "Zk9$wQ7!rT2x" for a, k, b in spans) and not any(text[a:b] == "password123" for a, _, b in spans)
    assert scan("")[:2] == scan(None)[:2] == ([], [])
    cost, parts = guess_cost("password1999aaaaqwerty")
    assert [k for k, *_ in parts] == ["word", "date", "repeat", "word"] and cost < 10


def test_guess_cost_is_brute_force():
    import re as regex
    from itertools import product
    from math import log10

    from tallyglass.llm.secrets import COMMON, _alphabet

    rows = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
    rank = {w: i + 1 for i, w in enumerate(COMMON)}

    def cost(v, i, j):
        s, low, n = v[i:j], v[i:j].lower(), j - i
        found = [_alphabet(v) * n]
        plain = low.translate(str.maketrans("013457@$!", "oieastasi"))
        if 3 <= n <= 16 and low in rank:
            found.append(log10(rank[low] + 1) + (0.3 if s != low else 0))
        elif 3 <= n <= 16 and plain in rank:
            found.append(log10(rank[plain] + 1) + 0.6)
        for pattern, c in ((r"(19|20)\d\d", 2.1), (r"(19|20)\d\d[-/.]?(0[1-9]|1[0-2])", 3.1), (r"(19|20)\d\d[-/.]?(0[1-9]|1[0-2])[-/.]?(0[1-9]|[12]\d|3[01])", 4.6)):
            if regex.fullmatch(pattern, s):
                found.append(c)
        if n >= 3 and len(set(s)) == 1:
            found.append(_alphabet(v) + log10(n))
        if n >= 3 and all(any(a + b in r or b + a in r for r in rows) for a, b in zip(low, low[1:], strict=False)):
            found.append(log10(40) + 0.3 + log10(n))
        return min(found)

    def brute(v):
        best = [0.0]
        for j in range(1, len(v) + 1):
            best.append(min(best[i] + cost(v, i, j) + (0.3 if i else 0) for i in range(j)))
        return best[-1]

    draw = random.Random(1)
    parts = ["asdfg", "hello", "qwe", "aaa", "111", "2024", "202401", "20240131", "Pass", "p@ssword", "X", "9", "zxcv", "lo", "test", "ttttt", "67890" * 9, "q" * 50, "wewewe" * 8]
    for v in ["asdfghello", "aaaabc", "testttt", *map("".join, product("aq1", repeat=5)), *("".join(draw.choices(parts, k=draw.randrange(1, 7))) for _ in range(250))]:
        got, split = guess_cost(v)
        assert abs(got - brute(v)) < 1e-9, (v, got, brute(v), split)
        assert [a for _, a, _ in split[1:]] == [b for *_, b in split[:-1]] and split[-1][2] == len(v)
    import time

    began = time.time()
    guess_cost("a" * 200_000), guess_cost("qw" * 100_000)
    assert time.time() - began < 60


def test_ordinary_words_are_no_secrets(spark):
    texts = [prose(200, k) + " plain ordinary garden words follow" for k in range(3, 9)] + ["pwd: ordinarygarden", "pwd: QwLmZxKvTpRbNsYd", "pwd: QwLmZxKvTpRbNsYd the pin is 839201746553", None, ""]
    got = scan_secrets(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_guess for r in got] == [0] * 7 + [1, 2, 0, 0]


def test_token_counts_follow_the_tokenizer():
    models = pytest.importorskip("tokenizers.models")
    draw = random.Random(2)
    for bytes_ in (False, True):
        pieces = {BLANK: -3.0, "a": -2.0, "b": -2.0, "ab": -4.0, BLANK + "a": -2.5, "ba": -3.5, "bab": -5.5, "abab": -6.0, "c": -4.0}
        extra = [(f"<0x{i:02X}>", 0.0) for i in range(256)] if bytes_ else []
        # Byte pieces are no part of the search: their score must not be the smallest.
        library = models.Unigram([("<unk>", 0.0), *pieces.items(), *extra], 0, bytes_)
        t = Tokens(pieces, bytes_)
        for _ in range(1500):
            s = BLANK + "".join(draw.choice("aabbbcéé" + BLANK) for _ in range(draw.randrange(1, 14)))
            assert t.best(s)[1] == len(library.tokenize(s)), s


def test_token_counts_of_a_public_vocabulary(spark):
    models = pytest.importorskip("tokenizers.models")
    from tallyglass.llm.token_counts import vocabulary

    pieces, bytes_ = vocabulary()
    assert bytes_
    library = models.Unigram([("<unk>", 0.0), *pieces.items(), *((f"<0x{i:02X}>", 0.0) for i in range(256))], 0, True)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect() if r.text]
    got = [r.n_tokens for r in count_tokens(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [len(library.tokenize(BLANK + t.replace(" ", BLANK))) for t in texts]


def test_mix(spark):
    texts = ["w " * (1 + i % 40) for i in range(400)]
    rows = spark.createDataFrame([(i, t, ["a", "b", None][i % 3]) for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    got = mix(rows).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= 40).all()
    assert got.sort_values("doc_id").equals(mix(rows.repartition(7)).toPandas().sort_values("doc_id").set_index(got.sort_values("doc_id").index))
    assert capped_shares([("a", 10), ("b", 10), (None, 1000)]) == {"a": 30.0, "b": 30.0, None: 960.0}


def test_query_names(spark):
    from tallyglass.llm.queries import oracle_sql, queries

    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries()) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries()) and json.dumps(oracle_sql())
