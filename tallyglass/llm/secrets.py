"""Secret scans: patterns, and guess costs of values in a credential context.

Patterns find assignments, access keys and hex strings. Beyond them, a value that
follows a credential word is split into words, dates, repeats, keyboard walks and
brute-force spans so that the product of guesses is smallest; values that cost at least
10 ** `MIN_COST` guesses are spans of kind `guess`. Words cost their rank: common
passwords come first, then the corpus's own words by the documents that have them.
"""

from __future__ import annotations

import hashlib
import re
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, staged

MIN_COST = 8.0
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(r"""(?i:\b(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret(?:_?key)?|token|api_?key|credentials?|auth(?:_?token)?|private_?key|client_?secret|bearer))["']?\x20{0,3}(?:[:=]|\x20is\x20)\x20{0,3}["']?([^\s"'<>]{6,})""", re.A)
_WORDS_OF = ("pass", "pwd", "pin", "secret", "token", "key", "credential", "auth", "bearer")
#: Common password words, most common first: a word costs its place in the list.
COMMON = (
    "password 123456 qwerty admin welcome letmein login master monkey dragon secret hello test user root guest "
    "changeme default example sample dummy placeholder null none true false abc iloveyou sunshine princess football "
    "baseball superman batman shadow michael jordan summer winter spring autumn love money computer internet server "
    "database system access private public token key your here insert replace todo xxx value string"
).split()
#: Words of the corpus that follow them in the ranking, the most frequent ones (by documents).
CORPUS_WORDS = 20_000
MIN_DOCS = 2
Ranks = dict[str, int]
_RANK: Ranks = {w: i + 1 for i, w in enumerate(COMMON)}
_LEET = str.maketrans("013457@$!", "oieastasi")
_NOT_LETTERS = "".join(chr(c) for c in range(128) if not chr(c).isalpha() and c != 32)
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEXT = {(a, b) for row in _ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in _ROWS for a, b in zip(row, row[1:])}
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"[-/.]?(?:0[1-9]|1[0-2])", r"[-/.]?(?:0[1-9]|[12]\d|3[01])"
_DATES = [re.compile(_YEAR, re.A), re.compile(_YEAR + _MONTH, re.A), re.compile(_YEAR + _MONTH + _DAY, re.A)]
_DATE_COST = (2.1, 3.1, 4.6)
#: No word or date is longer.
_LONGEST = 16


def _alphabet(text: str) -> float:
    kinds = (any(c.islower() for c in text), any(c.isupper() for c in text), any(c.isdigit() for c in text), any(not c.isalnum() for c in text))
    return log10(max(10, sum(n for k, n in zip(kinds, (26, 26, 10, 33), strict=True) if k)))


def _runs(low: str, joined) -> list[int]:
    """For each place, the end of the stretch in which all neighbours are `joined`."""
    end = [len(low)] * len(low)
    for i in range(len(low) - 2, -1, -1):
        end[i] = end[i + 1] if joined(low[i], low[i + 1]) else i + 1
    return end


def guess_cost(value: str, ranks: Ranks = _RANK) -> tuple[float, list[tuple[str, int, int]]]:
    """Smallest log10 of guesses over all segmentations of `value`, and that segmentation.

    Ties go to the segment that is offered first. Every segment after the first costs a
    factor of 2 more, for not knowing where it begins. Time grows with the length: within
    a long repeat or walk only places that a word or date can reach are cut, as going on
    costs less there than any other segment.
    """
    n, char = len(value), _alphabet(value)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    best: list[float] = [0.0] + [float("inf")] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)

    def offer(kind: str, i: int, j: int, cost: float) -> None:
        cost = best[i] + cost + (0.3 if i else 0.0)
        if cost < best[j] - 1e-12:
            best[j], back[j] = cost, (kind, i)

    same, walk = _runs(value, lambda a, b: a == b), _runs(low, lambda a, b: (a, b) in _NEXT)
    brute, since = 0, {"repeat": 0, "walk": 0}
    for i in range(n):
        if i:
            # A brute-force span may go on: its cost is linear, so only its best beginning matters.
            if best[i] + 0.3 <= best[brute] + (0.3 if brute else 0.0) + char * (i - brute):
                brute = i
        offer("brute", brute, i + 1, char * (i + 1 - brute))
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            rank = ranks.get(low[i:j])
            if rank:
                offer("word", i, j, log10(rank + 1) + (0.3 if value[i:j] != low[i:j] else 0))
            elif (rank := ranks.get(plain[i:j])) is not None:
                offer("word", i, j, log10(rank + 1) + 0.6)
        for pattern, cost in zip(_DATES, _DATE_COST, strict=True):
            if m := pattern.match(value, i):
                offer("date", i, m.end(), cost)
        for kind, end, base in (("repeat", same[i], char), ("walk", walk[i], log10(40) + 0.3)):
            if i and (same if kind == "repeat" else walk)[i - 1] != end:
                since[kind] = i
            if i - since[kind] <= _LONGEST:
                for j in range(max(i + 3, end - _LONGEST), end + 1):
                    offer(kind, i, j, base + log10(j - i))
    parts, at = [], n
    while at:
        kind, i = back[at]
        parts.append((kind, i, at))
        at = i
    return best[n], parts[::-1]


def scan(text: str | None, ranks: Ranks = _RANK) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]:
    """Base spans, all spans (start, kind, end; in order), and the largest guess cost."""
    if not text:
        return [], [], 0.0
    base = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    more, most = [], 0.0
    if any(w in low for w in _WORDS_OF) or any(w in low for w in ("passwd", "apikey", "api_key")):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:)]}")
            if len(value) < 6:
                continue
            cost = guess_cost(value, ranks)[0]
            most = max(most, cost)
            if cost >= MIN_COST:
                more.append((m.start(1), 3, m.start(1) + len(value)))
    return sorted(base), sorted(base + more), most


def corpus_ranks(docs: DataFrame, most: int = CORPUS_WORDS) -> Ranks:
    """Ranks of words: COMMON, then the `most` words of 3 to 16 Latin letters in the most documents (ties by word).

    Counted over all texts, but not in values of a credential context, and in MIN_DOCS
    documents at least. Only the `most` words reach the driver.
    """
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), CONTEXT.pattern, " ")
    low = F.translate(F.lower(bare), _NOT_LETTERS, " " * len(_NOT_LETTERS))
    words = docs.select(F.explode(F.array_distinct(F.split(low, " "))).alias("word")).filter(F.col("word").rlike("^[a-z]{3,16}$"))
    ranked = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_DOCS).orderBy(F.desc("n"), "word").limit(most)
    top = staged(ranked, "words").orderBy(F.desc("n"), "word").collect()  # tables first: else each task sends the driver its own
    ranks = dict(_RANK)
    for r in top:
        ranks.setdefault(r["word"], len(ranks) + 1)
    return ranks


def _digest(texts: list[str | None], ranks: Ranks) -> list[pa.Array]:
    n, sha, spans, cost = [], [], [], []
    write = lambda found: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
    for text in texts:
        base, all_, most = scan(text, ranks)
        n.append([sum(k == kind for _, k, _ in all_) for kind in range(4)])
        sha.append(hashlib.sha256(write(base).encode()).hexdigest())
        spans.append(write(all_))
        cost.append(most)
    return [*(pa.array([x[k] for x in n], pa.int64()) for k in range(4)), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(cost, pa.float64())]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans, max_cost.

    Null texts count as empty and have no span. Positions are code points, ends are
    exclusive; a pattern's span is its whole match, a guessed value's is the value.
    Only doc_id and text are read.
    """
    schema = "n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string, max_cost double"
    ranks = corpus_ranks(docs)
    return map_texts(docs, lambda: lambda texts: _digest(texts, ranks), schema)
