"""Ranked lexical search of many queries at once, with common sub-expressions shared between them.

An item's score of a document is a sum over its terms, so sets of terms that several items share need adding up only once per document.

1. Items are dealt into blocks of about `block_terms` terms. A block's items are put into terms ordered by how many items hold them, so that shared
   terms stand side by side; then neighbouring nodes that come up together in two or more places are joined into a new node, the most frequent first, until
   no pair comes up twice (`mine`). The nodes form a DAG: leaves are terms, inner nodes sums of two, items sums of a few nodes.
   Each round looks at neighbours alone, so it is linear in the block; a block is mined in a task of its own.
2. Documents are read once per block: words are counted where the text lies and only terms of the block stay (`postings`, stored). N, L and
   the terms' document counts are aggregations over that table, partial sums first.
3. Each task takes stored documents in batches, makes one accumulator per DAG node and batch (an inner node is one addition for all documents of the batch),
   sums an item's nodes, and keeps its own best k per item. The tasks' best meet in a salted top k: at most k rows per item and task.

The plan of a block is bounded by `block_terms` terms of at most `LONGEST` bytes or one item, whichever is longer, and goes to the tasks as it is; there are as many passes over the
documents as blocks. Scores are 64-bit whole numbers, the same whatever the order of additions; the arrays of a batch hold at most `CELLS` numbers.

Defined results: terms are runs of ASCII letters, digits and all signs beyond ASCII, with A-Z lower-cased; a null or empty text has none and is never
found. A term that comes up twice in an item counts twice. Repeated documents are ranked each for itself; equal scores go by doc_id, nulls first.
Items with the same item_id and text are one item; with different texts they are ranked apart and share the id. Null item ids are kept. Items without
terms, and empty tables, give no rows. Own columns only, so extra columns can't clash. A long text is one row and counted whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scale import top_k
from barloom.llm.common import materialise, only

#: ASCII signs that are no letters or digits become spaces, A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
BLOCK_TERMS = 200_000
CELLS = 4_000_000
#: Terms longer than this stand in the plan as their first bytes and a digest, in documents and items alike.
LONGEST = 64
NO_ID = -(1 << 63)


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def short(term: bytes) -> bytes:
    import hashlib
    return term if len(term) <= LONGEST else term[:16] + b" " + hashlib.sha256(term).digest()


def mine(items: list[list[bytes]]) -> tuple[list[bytes], list[tuple[int, int]], list[list[int]]]:
    """(leaf terms, inner nodes as pairs of nodes, nodes per item). Node i is leaf i, or inner node i - number of leaves."""
    held = Counter(t for item in items for t in set(item))
    leaves = sorted(held, key=lambda t: (-held[t], t))
    number = {t: i for i, t in enumerate(leaves)}
    rows = [sorted(number[t] for t in item) for item in items]
    inner: list[tuple[int, int]] = []
    while True:
        pairs = Counter(p for row in rows for p in zip(row, row[1:]))
        wanted = {p: c for p, c in pairs.items() if c > 1}
        if not wanted:
            return leaves, inner, rows
        order = sorted(wanted, key=lambda p: (-wanted[p], p))
        # A round takes the most frequent pairs, each node at most once, so that they don't compete for neighbours.
        taken, used = {}, set()
        for p in order:
            if not used & set(p):
                taken[p] = len(leaves) + len(inner)
                inner.append(p)
                used.update(p)
        changed = []
        for row in rows:
            out, i = [], 0
            while i < len(row):
                node = taken.get((row[i], row[i + 1])) if i + 1 < len(row) else None
                out.append(row[i] if node is None else node)
                i += 1 if node is None else 2
            changed.append(out)
        rows = changed


PLAN = "block int, leaves array<binary>, left array<int>, right array<int>, item_ids array<{kind}>, nodes array<array<int>>"


def plans(items: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """items: item_id, text. One row per block: its leaf terms, inner nodes, items and the nodes of each item."""
    kind = items.schema["item_id"].dataType.simpleString()

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(terms(t.as_py())) for t in texts], pa.int64())

    rows = materialise(only(items, item_id="item_id", text=F.coalesce(F.col("`text`"), F.lit("")).cast("binary")).distinct()
                       .withColumn("n", count("text")).filter("n > 0"), "search-items")
    total = rows.agg(F.sum("n")).first()[0] or 0
    n_blocks = -(-total // block_terms) or 1
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int"))

    def one(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        order = sorted(zip(t["text"].to_pylist(), t["item_id"].to_pylist()), key=lambda x: (x[0], x[1] is not None, x[1]))
        leaves, inner, nodes = mine([[short(w) for w in terms(text)] for text, _ in order])
        kinds = [pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(t.schema.field("item_id").type), pa.list_(pa.list_(pa.int32()))]
        values = [key[0].as_py(), leaves, [a for a, _ in inner], [b for _, b in inner], [i for _, i in order], nodes]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names=["block", "leaves", "left", "right", "item_ids", "nodes"])

    return blocks.groupBy("block").applyInArrow(one, PLAN.format(kind=kind))


def postings(docs: DataFrame, leaves: list[bytes]) -> DataFrame:
    """doc, n (terms with repeats) and, for the leaf terms it holds, their numbers and counts, of every document with a term."""
    number = {t: i for i, t in enumerate(leaves)}
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text in zip(b["doc"].to_pylist(), b["text"]):
                words = terms(text.as_py())
                if not words:
                    continue
                found = [(i, c) for w, c in Counter(words).items() if (i := number.get(w if len(w) <= LONGEST else short(w))) is not None]
                for o, v in zip(out, (doc, len(words), [i for i, _ in found], [c for _, c in found])):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=["doc", "n", "ids", "tfs"])

    d = only(docs, doc=F.coalesce(F.col("`doc_id`").cast("long"), F.lit(NO_ID)), text=F.col("`text`").cast("binary"))
    return d.mapInArrow(run, "doc long, n long, ids array<int>, tfs array<int>")


def weights(posts: DataFrame) -> tuple[int, int, dict[int, int]]:
    """N, L and the weight of each leaf that a document holds; the map is bounded by the block's terms."""
    n_docs, n_terms = posts.agg(F.count("*"), F.sum("n")).first()
    df = posts.select(F.explode("ids").alias("i")).groupBy("i").agg(F.count("*").alias("df"))
    w = df.select("i", F.floor(F.log((F.lit(2 * n_docs + 2)).cast("double") / (F.col("df") * 2 + 1).cast("double")) * 1000).cast("long"))
    return n_docs, n_terms or 0, dict(map(tuple, w.collect()))


class Dag:
    """Accumulators of a batch of documents along a block's DAG."""

    def __init__(self, n_leaves: int, left: list[int], right: list[int], nodes: list[list[int]]):
        depth = [0] * n_leaves
        for a, b in zip(left, right):
            depth.append(1 + max(depth[a], depth[b]))
        level = np.array(depth[n_leaves:], np.int64)
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        self.levels = [(n_leaves + at, a[at], b[at]) for d in range(1, max(depth, default=0) + 1) for at in [np.flatnonzero(level == d)]]
        self.size, self.flat = n_leaves + len(left), np.array([x for row in nodes for x in row], np.int64)
        self.starts = np.cumsum([0, *[len(row) for row in nodes]])[:-1]

    def scores(self, n_docs: int, ids: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Items by documents; values are those of leaf ids in documents at."""
        acc = np.zeros((self.size, n_docs), np.int64)
        acc[ids, at] = values
        for to, a, b in self.levels:
            acc[to] = acc[a] + acc[b]
        return np.add.reduceat(acc[self.flat], self.starts, axis=0)


def best_of_block(posts: DataFrame, plan, k: int) -> DataFrame:
    """item_no (in the plan), doc, score: each task's k best documents of every item."""
    n_docs, n_terms, w_of = weights(posts)
    n_leaves, n_items = len(plan["leaves"]), len(plan["item_ids"])
    shape = (n_leaves, plan["left"], plan["right"], plan["nodes"])
    w = np.zeros(n_leaves, np.int64)
    w[list(w_of)] = list(w_of.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dag = Dag(*shape)
        width = max(1, CELLS // max(dag.size, len(dag.flat)))
        scores, docs = [np.zeros(0, np.int64)] * n_items, [np.zeros(0, np.int64)] * n_items
        least, worst = np.zeros(n_items, np.int64), np.full(n_items, NO_ID)
        for b in batches:
            for lo in range(0, b.num_rows, width):
                part = b.slice(lo, width)
                ids, tf = (part[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "tfs"))
                n, doc = (part[c].to_numpy(zero_copy_only=False) for c in ("n", "doc"))
                at = np.repeat(np.arange(part.num_rows), part["ids"].value_lengths().to_numpy(zero_copy_only=False))
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                got = dag.scores(part.num_rows, ids, at, w[ids] * ((1000000000 * tf) // (1000 * tf + 12 * m[at])))
                better = (got > least[:, None]) | (got == least[:, None]) & (got > 0) & (doc[None, :] < worst[:, None])
                items, places = np.nonzero(better)
                cuts = np.searchsorted(items, np.arange(n_items + 1))
                for i in np.unique(items):
                    new = places[cuts[i]:cuts[i + 1]]
                    s, d = np.concatenate([scores[i], got[i, new]]), np.concatenate([docs[i], doc[new]])
                    keep = np.lexsort((d, -s))[:k]
                    scores[i], docs[i] = s[keep], d[keep]
                    if len(keep) == k:
                        least[i], worst[i] = s[keep[-1]], d[keep[-1]]
        number = np.repeat(np.arange(n_items), [len(x) for x in docs])
        columns = [number, np.concatenate([*docs, np.zeros(0, np.int64)]), np.concatenate([*scores, np.zeros(0, np.int64)])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_no", "doc", "score"])

    return posts.mapInArrow(run, "item_no long, doc long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item that score above 0."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    ready = materialise(plans(items, block_terms), "search-plans")
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for (block,) in ready.select("block").collect():
        plan = ready.filter(F.col("block") == block).first()
        posts = materialise(postings(docs, [bytes(t) for t in plan["leaves"]]), "search-postings")
        best = top_k(best_of_block(posts, plan, k), ["item_no"], [F.col("score").desc(), F.col("doc")], k, ["doc"], "rank")
        names = spark.createDataFrame(list(enumerate(plan["item_ids"])), f"item_no long, item_id {kind}")
        best = best.join(names, "item_no").select("item_id", F.col("rank").cast("int"), F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "score")
        out = out.unionByName(materialise(best, "search-ranked"))
    return out
