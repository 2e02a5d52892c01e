"""Token counts of a unigram vocabulary, without making tokens.

A pattern automaton lists the vocabulary's matches; dynamic programming over their ends
carries the best score and the number of pieces. Ties follow the public unigram
tokenizer: candidates come by rising start, and only a strictly larger score replaces
one. A character that no piece covers costs `min score - 10` and counts as its bytes
where the vocabulary has byte pieces, else a run of such characters counts as one. No piece of such vocabularies goes on
past a blank, so words are settled one by one, and known words from memory.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

PATH = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "\u2581"
#: Words whose counts a task remembers.
MEMORY = 400_000
_UNKNOWN = 10.0
_CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def vocabulary(path: str = PATH) -> tuple[dict[str, float], bool]:
    """Scores of the pieces of a sentencepiece model file, and whether it has byte pieces. Driver only."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, bytes_ = {}, False
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            bytes_ = True
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[sp.id_to_piece(i)] = float(sp.get_score(i))
    return pieces, bytes_


class Counter:
    """Counts pieces of texts."""

    def __init__(self, pieces: dict[str, float], bytes_: bool):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.auto.add_word(piece, (len(piece), score))
        if pieces:
            self.auto.make_automaton()
        self.unknown = min(pieces.values(), default=0.0) - _UNKNOWN
        self.bytes = bytes_
        self.whole = any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.known: dict[str, int] = {}

    def best(self, text: str) -> tuple[float, int]:
        """Best score of `text` (blanks already marked) and its number of pieces."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.auto):
            for end, match in self.auto.iter(text):
                ends[end].append(match)
        score, count, odd = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            top, at, single, unknown = None, 0, False, False
            for size, value in sorted(ends[end], reverse=True):  # by rising start
                single |= size == 1
                total = score[end + 1 - size] + value
                if top is None or total > top:
                    top, at = total, count[end + 1 - size] + 1
            if not single:
                total = score[end] + self.unknown
                if top is None or total > top:
                    top, at, unknown = total, count[end] + (len(text[end].encode("utf-8", "replace")) if self.bytes else not odd[end]), True
            score[end + 1], count[end + 1], odd[end + 1] = top, at, unknown
        return score[n], count[n]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        marked = BLANK + text.replace(" ", BLANK)
        if self.whole:
            return self.best(marked)[1]
        total, known = 0, self.known
        for word in _CHUNK.findall(marked):
            n = known.get(word)
            if n is None:
                n = self.best(word)[1]
                if len(word) < 64:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[word] = n
            total += n
        return total


def count_tokens(docs: DataFrame, path: str = PATH) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_chars (code points), n_bytes (UTF-8).

    Null and empty texts have no tokens. Only doc_id and text are read. The vocabulary
    is read once, on the driver, and goes to the tasks with the function.
    """
    pieces, bytes_ = vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, bytes_))  # as large as the vocabulary, whatever the input

    def make():
        counter = Counter(*shared.value)

        def work(texts: list[str | None]) -> list[pa.Array]:
            tokens = pa.array([counter(t) for t in texts], pa.int64())
            chars = pa.array([len(t or "") for t in texts], pa.int64())
            return [tokens, chars, pa.array([len((t or "").encode("utf-8", "replace")) for t in texts], pa.int64())]

        return work

    return map_texts(docs, make, "n_tokens bigint, n_chars bigint, n_bytes bigint")
