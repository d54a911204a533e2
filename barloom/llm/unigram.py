"""Piece counts of unigram tokenization, without the pieces: one Aho-Corasick pass lists the vocabulary's matches, and a
forward pass keeps, for every end, the best score and the number of pieces on the path that has it.

Tie rule: among paths of equal score to an end, the one whose last piece begins first stays; a later one must be better. A letter
that is no piece by itself may also be unknown, at the smallest score less a penalty; it counts as its UTF-8 bytes, or, without byte fallback,
a run of unknown letters counts as one piece. A space is put before the text, and spaces are written as the vocabulary writes them.

No piece goes on over a space that follows a letter, so texts fall into words whose counts are kept per worker; if pieces do
that, or if scores are not whole numbers (sums would round differently by place), texts are taken as a whole.

Defined results: null and empty texts have no pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
PENALTY = 10.0


class PieceCounter:
    """pieces: normal pieces with their scores."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, memo: int = 500_000):
        self.byte_fallback, self.memo = byte_fallback, memo
        self.find = ahocorasick.Automaton()
        for text, score in pieces:
            self.find.add_word(text, (len(text), score))
        self.find.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        known = set("".join(t for t, _ in pieces))
        self.by_word = all(float(s).is_integer() for _, s in pieces) and not any(SPACE in t.lstrip(SPACE) for t, _ in pieces) and SPACE in known
        # A line end that no piece has is always unknown, and with byte fallback unknown letters don't join.
        self.words = re.compile(r" +[^ \n]*|[^ \n]+|\n" if "\n" not in known and byte_fallback else r" +[^ ]*|[^ ]+").findall
        self.known: dict[str, tuple[int, float]] = {}

    def _best(self, text: str) -> tuple[int, float]:
        text = text.replace(" ", SPACE)
        n = len(text)
        score, count, last_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, m in self.find.iter(text):
            matches[end].append(m)  # of one end the longest comes first, which is the one that begins first
        for e in range(n):
            best, start, single = None, e, False
            for size, s in matches[e]:
                single = single or size == 1
                s += score[e + 1 - size]
                if best is None or s > best:
                    best, start = s, e + 1 - size
            unknown = False
            if not single and (best is None or score[e] + self.unknown > best):
                best, start, unknown = score[e] + self.unknown, e, True
            score[e + 1], last_unknown[e + 1] = best, unknown
            count[e + 1] = count[start] + ((len(text[e].encode("utf-8")) if self.byte_fallback else 1 - last_unknown[e]) if unknown else 1)
        return count[n], score[n]

    def word(self, w: str) -> tuple[int, float]:
        got = self.known.get(w)
        if got is None:
            if len(self.known) >= self.memo:
                self.known.clear()
            got = self.known[w] = self._best(w)
        return got

    def count(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of the best path."""
        if not text:
            return 0, 0.0
        text = " " + text.replace(SPACE, " ")
        if not self.by_word:
            return self._best(text)
        n, score = 0, 0.0
        for k, s in map(self.word, self.words(text)):
            n += k
            score += s
        return n, score


def pieces_of(path: str) -> list[tuple[str, float]]:
    """Normal pieces and scores of a sentencepiece file."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
            if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]


_LOADED: dict[str, PieceCounter] = {}


def loaded(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(pieces_of(path))
    return _LOADED[path]


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_pieces and score, over the column `text`."""
    @F.pandas_udf("n_pieces long, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = loaded(path)
        for s in texts:
            yield pd.DataFrame([counter.count(t) for t in s], columns=["n_pieces", "score"])

    return docs.withColumn("__c", run(F.col("`text`"))).select(*[F.col(f"`{c}`") for c in docs.columns], "__c.*")
