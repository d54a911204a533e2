"""Token ids in grammar-compressed shards, with random access to documents.

Documents are dealt out in ascending doc_id order; a task encodes its range and closes a shard whenever `shard_ids` ids are gathered (a shard holds
whole documents). Inside a shard Re-Pair runs in rounds: all pairs of neighbouring symbols are counted, each pair within a factor
of the most frequent one becomes a new symbol, its occurrences are replaced from the left without overlap, until no pair is frequent. A shard stores its rules,
how many ids each new symbol stands for, the remaining symbols and the documents' lengths. To read one document, a running sum of those
lengths finds the symbols that cover it, and only these are expanded.

A file is a Parquet part of the given folder, a shard one of its rows: part and shard (order), n_ids, base (first new symbol), and the binary columns docs
(int64), lengths (int64), rules (uint32 pairs), spans (int64), symbols (uint16 where all fit, else uint32), all little-endian.
Spark writes and reads it, so it may lie in any store.

Defined results: null is the empty text, so a document has at least its end id; a null doc_id comes first; rows with one doc_id follow
one another by text hash.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import only
from barloom.llm.pretokens import byte_letters, byte_pieces

NO_ID = -(1 << 63)
SHARD = ("part int, shard int, n_ids long, base long, docs binary, lengths binary, rules binary, spans binary, symbols binary")


class Pieces(dict):
    """Ids of pieces, as bytes. A piece that is not there goes to the vocabulary's own merges, past the rest of the library, and stays until `memo` are held."""

    def __init__(self, model, memo: int):
        super().__init__()
        self.model, self.memo, self.letters = model, memo, "".join(byte_letters())

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.memo:
            self.clear()
        shown = charmap_decode(piece.encode(), "strict", self.letters)[0]
        self[piece] = ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids


class WordEncoder:
    """The tokenizers library's ids, with the ids of each piece between splits asked for once."""

    def __init__(self, path: str, memo: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        self.base = tok.get_vocab_size(with_added_tokens=True)
        self.special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self.known = Pieces(tok.model, memo)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(chain.from_iterable(self._ids(t))), np.uint32) for t in texts]

    def _ids(self, text: str) -> Iterator[Iterable[bytes]]:
        for part in self.parts(text):
            if part in self.special:
                yield [array("I", [self.special[part]]).tobytes()]
            else:
                yield map(self.known.__getitem__, byte_pieces(part))


_LOADED: dict[str, WordEncoder] = {}


def loaded(path: str) -> WordEncoder:
    """One encoder a worker process; what it has looked up serves the tasks that follow."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


BUCKETS = 1 << 19


def _frequent(keys: np.ndarray, bucket: np.ndarray, least: int, factor: int, room: int) -> np.ndarray:
    """Keys that come up at least `least` times and within `factor` of the most frequent, the `room` first by count, one for each bucket; a key
    that gives way to another of its bucket has its turn in a later round."""
    heavy = np.bincount(bucket, minlength=BUCKETS) >= least
    some, n = np.unique(keys[heavy[bucket]], return_counts=True)
    if not len(some) or n.max() < least:
        return some[:0]
    held = np.flatnonzero(n >= max(least, n.max() // factor))
    held = held[np.lexsort((some[held], -n[held]))]
    _, first = np.unique(_bucket(some[held]), return_index=True)
    return some[held[np.sort(first)[:room]]]


def _bucket(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) >> np.int64(44)) & np.int64(BUCKETS - 1)


def compress(ids: np.ndarray, base: int, least: int = 8, factor: int = 16, rounds: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols; rule r makes symbol base + r), ids that each stands for, and the symbols that remain."""
    seq, rules, spans = ids.astype(np.int64), np.empty((0, 2), np.int64), np.empty(0, np.int64)
    slot = np.full(BUCKETS, -1, np.int32)
    for _ in range(rounds):
        room = (1 << 16) - base - len(rules)
        if len(seq) < 2 or room <= 0:
            break
        keys = seq[:-1] << 32 | seq[1:]
        bucket = _bucket(keys)
        chosen = _frequent(keys, bucket, least, factor, room)
        if not len(chosen):
            break
        mine = _bucket(chosen)
        slot[mine] = np.arange(len(chosen))
        place = slot[bucket]
        slot[mine] = -1
        at = np.flatnonzero(place >= 0)
        at = at[chosen[place[at]] == keys[at]]
        rule = place[at]
        # In a run of overlapping occurrences every second one, from the left, is replaced.
        start = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        within = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        at, rule = at[within % 2 == 0], rule[within % 2 == 0]
        size = lambda s: np.where(s >= base, spans[np.maximum(s - base, 0)] if len(spans) else 1, 1)
        pairs = np.stack([chosen >> 32, chosen & 0xFFFFFFFF], 1)
        new_spans = size(pairs[:, 0]) + size(pairs[:, 1])
        seq[at] = base + len(rules) + rule
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, rules, spans = seq[keep], np.concatenate([rules, pairs]), np.concatenate([spans, new_spans])
    return rules, spans, seq


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that symbols stand for."""
    seq = seq.astype(np.int64)
    while len(rules) and (big := seq >= base).any():
        wide = 1 + big
        end = np.cumsum(wide)
        out = np.empty(end[-1], np.int64)
        out[end - wide] = np.where(big, rules[np.where(big, seq - base, 0), 0], seq)
        out[end[big] - 1] = rules[seq[big] - base, 1]
        seq = out
    return seq


def shard_row(part: int, shard: int, docs: list[int], arrays: list[np.ndarray], base: int) -> tuple:
    ids = np.concatenate(arrays)
    rules, spans, seq = compress(ids, base)
    kind = "<u2" if base + len(rules) <= 1 << 16 else "<u4"
    return (part, shard, len(ids), base, np.array(docs, "<i8").tobytes(), np.array([len(a) for a in arrays], "<i8").tobytes(),
            rules.astype("<u4").tobytes(), spans.astype("<i8").tobytes(), seq.astype(kind).tobytes())


class Shard:
    """A stored row, read back."""

    def __init__(self, row):
        self.base, self.rules = int(row.base), np.frombuffer(row.rules, "<u4").astype(np.int64).reshape(-1, 2)
        self.docs, lengths = np.frombuffer(row.docs, "<i8"), np.frombuffer(row.lengths, "<i8")
        kind = "<u2" if self.base + len(self.rules) <= 1 << 16 else "<u4"
        self.seq = np.frombuffer(row.symbols, kind)
        own = np.frombuffer(row.spans, "<i8")
        self.spans = np.concatenate([np.ones(self.base, np.int64), own])
        self.edge = np.concatenate([[0], np.cumsum(self.spans[self.seq])])
        # Every rule written out, one behind the other, with an id itself as its own text before them.
        self.text = np.concatenate([np.arange(self.base), expand(np.arange(self.base, self.base + len(own)), self.rules, self.base)])
        self.begin = np.concatenate([np.arange(self.base), self.base + np.cumsum(own) - own])
        self.start = np.concatenate([[0], np.cumsum(lengths)])

    def ids(self, i: int, j: int | None = None) -> np.ndarray:
        """Ids of documents i to j - 1 of the shard, expanding only the symbols that cover them."""
        lo, hi = self.start[i], self.start[i + 1 if j is None else j]
        a, b = np.searchsorted(self.edge, lo, "right") - 1, np.searchsorted(self.edge, hi, "left")
        symbols, at = self.seq[a:b], self.edge[a:b] - self.edge[a]
        size = self.spans[symbols]
        out = self.text[np.repeat(self.begin[symbols] - at, size) + np.arange(self.edge[b] - self.edge[a])]
        return out[lo - self.edge[a]:hi - self.edge[a]]


def write_ids(docs: DataFrame, tokenizer: str, folder: str, shard_ids: int = 1 << 18, end_id: int = 0) -> None:
    """Encode docs (doc_id, text) and write shards to `folder`."""
    d = only(docs, k=F.coalesce("doc_id", F.lit(NO_ID)), text=F.coalesce("text", F.lit("")))
    d = d.withColumn("th", F.xxhash64("text")).repartitionByRange("k", "th").sortWithinPartitions("k", "th")

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = loaded(tokenizer)
        docs_, arrays, held, n, part = [], [], 0, 0, 0
        row = lambda: pd.DataFrame([shard_row(part, n, docs_, arrays, enc.base)], columns=[c.split()[0] for c in SHARD.split(", ")])
        for pdf in batches:
            for k, text, part in zip(pdf["k"], pdf["text"], pdf["part"]):
                ids = np.append(enc.encode([text])[0], np.uint32(end_id))
                docs_.append(k)
                arrays.append(ids)
                held += len(ids)
                if held >= shard_ids:
                    yield row()
                    docs_, arrays, held, n = [], [], 0, n + 1
        if docs_:
            yield row()

    (d.select("k", "text", F.spark_partition_id().alias("part")).mapInPandas(shards, SHARD).write.parquet(folder))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document: doc_id, start, n_tokens, ids_crc32, from the files."""
    files = spark.read.schema(SHARD).parquet(folder)
    counts = files.select("part", "shard", "n_ids")
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = counts.withColumn("within", F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids"))
    first = inside.join(base, "part").select("part", "shard", (F.col("before") + F.col("within")).alias("first"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                s = Shard(row)
                ids = s.ids(0, len(s.docs)).astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(s.start[:-1], s.start[1:])]
                yield pd.DataFrame({"k": s.docs, "start": row.first + s.start[:-1], "n_tokens": np.diff(s.start), "ids_crc32": crc})

    return (files.join(first, ["part", "shard"]).mapInPandas(each, "k long, start long, n_tokens long, ids_crc32 long")
            .select(F.nullif("k", F.lit(NO_ID)).alias("doc_id"), "start", "n_tokens", "ids_crc32"))
