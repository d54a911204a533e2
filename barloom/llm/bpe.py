"""BPE encoding by backtracking, and decoding by an offset table.

A word's BPE is the one sequence of vocabulary matches in which every two neighbours are compatible: the merges that made
them would not have joined anything across their border first. The encoder takes the longest match (from one Aho-Corasick pass over the
word), checks it against its left neighbour in a memo table of pair compatibility, takes shorter ones where that fails, and steps back where none
is left, never to return to that place; so it does a bounded number of steps per byte, whatever the number of merges. Decoding
cuts the tokens' texts out of one string by a table of offsets.

Defined results: null is the empty text; an empty text has no tokens and decodes to the empty text; special tokens' texts are
found before anything else, as the vocabulary file says. Very long words are encoded like others.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Memo
from barloom.llm.pretokens import byte_letters, lowered, word_pieces

INF = float("inf")
#: Added to a byte's sign at a word's end, where the vocabulary writes its end mark.
END = 0x4000


class Backtracking:
    """Encoder and decoder for one vocabulary file with byte-level BPE and a word-end mark."""

    def __init__(self, path: str, memo: int = 96_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.signs = byte_letters()
        self._merges(model["merges"])
        self._offsets(spec)
        self.words, self.pairs = Memo(memo), Memo(memo // 2)

    def _merges(self, merges: list) -> None:
        ids = self.ids
        self.join: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            t = ids[a + b]
            self.join[ids[a], ids[b]] = r
            if t not in self.rank:
                self.rank[t], self.left[t], self.right[t] = r, ids[a], ids[b]
        live: set[int] = set()
        find = ahocorasick.Automaton()
        for text, t in sorted(ids.items(), key=lambda x: self.rank.get(x[1], -1)):
            body = text[:-len(self.suffix)] if self.suffix and text.endswith(self.suffix) and len(text) > len(self.suffix) else None
            key = text if body is None else body[:-1] + chr(ord(body[-1]) + END)
            made = t in self.rank
            if text in self.special or not made and len(key) > 1:
                continue
            if made and not (self.left[t] in live and self.right[t] in live and self._fit(self.left[t], self.right[t], self.rank[t])):
                continue  # its own text is encoded otherwise
            live.add(t)
            find.add_word(key, (t, len(key)))
        find.make_automaton()
        self.find = find

    def _fit(self, a: int, b: int, limit: float = INF) -> bool:
        """Would merges, run up to `limit`, leave the border between a and b alone? Both are undone, last merge first; of equal ones the right."""
        join, rank = self.join, self.rank
        while True:
            if join.get((a, b), INF) < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.right[a]
            else:  # a merge equal to b's own would have come first, being further left
                limit, b = rb + 0.5, self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            got = self.pairs.keep((a, b), self._fit(a, b), 200)
        return got

    def encode_word(self, word: str) -> list[int]:
        signs = self.signs
        text = "".join(signs[b] for b in word.encode("utf-8"))
        if self.suffix:
            text = text[:-1] + chr(ord(text[-1]) + END)
        n = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (t, size) in self.find.iter(text):
            at[end + 1 - size].append((t, size))  # by end, so the longest come last
        tokens: list[tuple[int, int]] = []
        tries = [len(at[0])]
        closed = bytearray(n + 1)
        pos = 0
        while pos < n:
            k, here = tries[-1], at[pos]
            while k:
                k -= 1
                t, size = here[k]
                if not closed[pos + size] and (not tokens or self.compatible(tokens[-1][0], t)):
                    tries[-1] = k
                    tokens.append((t, pos))
                    pos += size
                    tries.append(len(at[pos]) if pos < n else 0)
                    break
            else:
                closed[pos] = 1
                tries.pop()
                pos = tokens.pop()[1]
        return [t for t, _ in tokens]

    def _offsets(self, spec: dict) -> None:
        by_id = {i: t for t, i in {**self.ids, **self.special}.items()}
        texts = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.text = "".join(texts)

    def decode(self, ids: list[int]) -> str:
        """Tokens with a space between them: the file names no decoder."""
        o, s = self.offsets, self.text
        return " ".join([s[o[i]:o[i + 1]] for i in ids])

    def word(self, w: str) -> tuple[int, str, str]:
        """Count, ids as text, and decoded text of a word."""
        got = self.words.get(w)
        if got is None:
            ids = self.encode_word(w)
            got = self.words.keep(w, (len(ids), " ".join(map(str, ids)), self.decode(ids)), 350 + 8 * len(w) + 8 * len(ids))
        return got

    def forget(self) -> None:
        """Memos are a task's own; the tables stay with the worker."""
        self.words.empty()
        self.pairs.empty()

    def pieces(self, text: str) -> Iterator[tuple[int, str, str]]:
        for part in self.split_special(text) if self.split_special else [text]:
            if part in self.special:
                i = self.special[part]
                yield 1, str(i), self.decode([i])
            elif part:
                part = lowered(part if part.isascii() else unicodedata.normalize("NFC", part))
                yield from map(self.word, word_pieces(part))

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, s, _ in self.pieces(text) for i in s.split(" ")]


_LOADED: dict[str, Backtracking] = {}


def loaded(path: str) -> Backtracking:
    """One encoder a worker process; its tables are made once."""
    if path not in _LOADED:
        _LOADED[path] = Backtracking(path)
    return _LOADED[path]


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """docs with a column `ids`, the tokens of `text`."""
    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = loaded(path)
        for s in texts:
            yield pd.Series([enc.encode(t) if t else [] for t in s])
        enc.forget()

    return docs.withColumn("ids", ids(F.col("`text`")))


def decode_ids(docs: DataFrame, path: str) -> DataFrame:
    """docs with a column `decoded`, the text of the column `ids`."""
    @F.pandas_udf("string")
    def text(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = loaded(path)
        for s in rows:
            yield pd.Series([enc.decode(list(i)) for i in s])

    return docs.withColumn("decoded", text(F.col("`ids`")))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of `text`, encoded and decoded where it is."""
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = loaded(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for s in texts:
            rows = []
            for t in s:
                got = list(enc.pieces(t)) if t else []
                rows.append((sum(x[0] for x in got), sha(" ".join([x[1] for x in got])), sha(" ".join([x[2] for x in got]))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        enc.forget()

    return docs.withColumn("__d", run(F.col("`text`"))).select(*[F.col(f"`{c}`") for c in docs.columns], "__d.*")
