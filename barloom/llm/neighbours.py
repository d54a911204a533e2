"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fit in one task on a bounded sample (`sample_rows`, by hash over the whole table): every node's vectors are split by
k-means into `branches` children until a node has at most `leaf_rows`. Every row goes down to the child with the nearest centre and ends
in a leaf. A query goes down the same way, keeps the children it passed in a priority queue by the distance of their centres,
and goes on from the nearest of them; the order in which it reaches leaves is its visiting order. How many leaves are visited is calibrated:
`probes` vectors of the sample are searched exhaustively over all rows, and visits widen until the mean recall reaches `recall`.

Vectors and queries of a leaf meet in blocks of bounded size, each of which gives every query its `k` nearest; the blocks'
results are merged. A leaf of any size, also of equal vectors, is many blocks.

Defined results: vectors that are null, empty, all zero, or hold a null, NaN or infinite component take no part, nor do rows without an id
or with a dimension other than the most common one (of equally common ones the smallest). Rows that share a query's id are that one query, whose vector is
their smallest; they are not its candidates. Equal distances go to the smaller id. Without rows there are no results.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import materialise, only


class Tree:
    """centres: a row per node; children: node numbers per node, empty for leaves; leaf: running number of a leaf, else -1."""

    def __init__(self, vectors: np.ndarray, branches: int, leaf_rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.children: list[list[int]] = []
        centres: list[np.ndarray] = []

        def node(rows: np.ndarray, centre: np.ndarray) -> int:
            i = len(self.children)
            self.children.append([])
            centres.append(centre)
            if len(rows) > leaf_rows:
                parts = kmeans(vectors[rows], branches, rng)
                groups = [rows[parts == g] for g in range(branches)]
                groups = [g for g in groups if len(g)]
                if len(groups) > 1:
                    self.children[i] = [node(g, vectors[g].mean(0)) for g in groups]
            return i

        node(np.arange(len(vectors)), vectors.mean(0))
        self.centres = np.array(centres)
        ends = [i for i, c in enumerate(self.children) if not c]
        self.leaf = np.full(len(self.children), -1)
        self.leaf[ends] = np.arange(len(ends))
        self.n_leaves = len(ends)

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf that each row ends in."""
        out = np.empty(len(vectors), np.int64)
        work = [(0, np.arange(len(vectors)))]
        while work:
            i, rows = work.pop()
            if not len(rows):
                continue
            c = self.children[i]
            if not c:
                out[rows] = self.leaf[i]
                continue
            near = squared(vectors[rows], self.centres[c]).argmin(1)
            work += [(n, rows[near == k]) for k, n in enumerate(c)]
        return out

    def visits(self, q: np.ndarray, most: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order, at most so many, but until they hold `least` rows; rows: how many each leaf holds."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held < least):
            _, i = heapq.heappop(queue)
            while c := self.children[i]:
                d = ((self.centres[c] - q) ** 2).sum(1)
                best = int(d.argmin())
                for k, n in enumerate(c):
                    if k != best:
                        heapq.heappush(queue, (float(d[k]), n))
                i = c[best]
            out.append(int(self.leaf[i]))
            held += least if rows is None else int(rows[out[-1]])
        return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, good for choosing."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    part = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        part = squared(x, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(part, minlength=len(centres))
        np.add.at(sums, part, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return part


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, row, distance) of each query's k nearest rows with another id; ties to the smaller id. Products choose
    candidates with room for rounding, differences give the distances."""
    rough = squared(q, x)
    rough[q_ids[:, None] == x_ids[None]] = np.inf
    room = 1e-9 * ((q * q).sum(1) + (x * x).sum(1).max(initial=0))
    for i in range(len(q)):
        bound = np.partition(rough[i], k - 1)[k - 1] if len(x) > k else np.inf
        near = np.flatnonzero((rough[i] <= bound + room[i]) & (rough[i] < np.inf))
        d = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
        for j in np.lexsort((x_ids[near], d))[:k]:
            yield int(q_ids[i]), int(x_ids[near[j]]), float(d[j])


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v for rows that take part. rows: vec_id, embedding."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    r = (only(rows, vec_id="vec_id", embedding="embedding").withColumn("v", v)
         .filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda e: e != 0)))
    dim = r.groupBy(F.size("v").alias("d")).count().agg(F.max_by("d", F.struct(F.col("count"), -F.col("d")))).scalar()
    return r.filter(F.size("v") == dim).select("vec_id", "v")


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.empty((0, 1))


def fit_tree(vectors: DataFrame, sample_rows: int, branches: int, leaf_rows: int) -> tuple[Tree, np.ndarray] | None:
    """The tree and its sample's vectors, in hash order. Rows are drawn by id and vector, and equal ones once, so an id or a vector that many rows share is one
    row of the sample. If none is drawn, one row makes a tree of one leaf, under which everything is compared."""
    n = vectors.count()
    if not n:
        return None
    h = F.xxhash64(F.lit("tree"), "vec_id", "v")
    share = int(min(1.0, sample_rows / n) * (1 << 30))
    sample = vectors.filter(F.pmod(h, F.lit(1 << 30)) < share).select(F.lit(0).alias("g"), h.alias("h"), "v").distinct()
    sample = materialise(sample, "ann-sample")
    if sample.isEmpty():
        sample = vectors.select(F.lit(0).alias("g"), h.alias("h"), "v").limit(1)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf.sort_values("h", kind="stable")["v"])
        return pd.DataFrame({"tree": [pickle.dumps((Tree(x, branches, leaf_rows), x[:256]))]})

    got = sample.groupBy("g").applyInPandas(fit, "tree binary").collect()
    return pickle.loads(bytes(got[0]["tree"]))


def index(vectors: DataFrame, tree: Tree) -> DataFrame:
    """vectors with the leaf of every row."""
    sent = vectors.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def leaf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(sent.value.leaves_of(_matrix(s)).astype(np.int32))

    return vectors.withColumn("leaf", leaf("v"))


def calibrated_visits(indexed: DataFrame, tree: Tree, probes: np.ndarray, k: int, recall: float) -> int:
    """Leaves to visit so that the probes' mean recall over all rows is reached. A probe's nearest row is itself and is left out."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, ids = _matrix(pdf["v"]), pdf["vec_id"].to_numpy()
            leaf = dict(zip(ids.tolist(), pdf["leaf"].tolist()))
            found = list(nearest(probes, np.full(len(probes), -(1 << 62)) - np.arange(len(probes)), x, ids, k + 1))
            yield pd.DataFrame({"p": [-(1 << 62) - a for a, _, _ in found], "vec_id": [b for _, b, _ in found], "d": [d for _, _, d in found],
                                "leaf": [leaf[b] for _, b, _ in found]})

    first = Window.partitionBy("p").orderBy("d", "vec_id")
    rows = (indexed.mapInPandas(scan, "p long, vec_id long, d double, leaf int").withColumn("r", F.row_number().over(first))
            .filter((F.col("r") > 1) & (F.col("r") <= k + 1)).select("p", "leaf").collect())
    if not rows:
        return tree.n_leaves
    order = {p: {leaf: i for i, leaf in enumerate(tree.visits(q, tree.n_leaves))} for p, q in enumerate(probes)}
    at = np.sort([order[r["p"]][r["leaf"]] for r in rows])
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


def search(rows: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.96, sample_rows: int = 10_000, branches: int = 8,
           leaf_rows: int = 40, probes: int = 128, block_rows: int = 4000, block_queries: int = 500) -> DataFrame:
    """rows, queries: vec_id, embedding. query_id, rank, vec_id, score of each query's k nearest found."""
    x = usable(rows)
    q = usable(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    none = "query_id long, rank int, vec_id long, score double"
    fitted = fit_tree(x, sample_rows, branches, leaf_rows)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], none)
    tree, sample = fitted
    indexed = materialise(index(x, tree), "ann-index")
    most = calibrated_visits(indexed, tree, sample[:probes], k, recall)
    held = np.zeros(tree.n_leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # a row per leaf of the bounded tree
        held[r["leaf"]] = r["count"]
    sent = rows.sparkSession.sparkContext.broadcast((tree, held))
    # So many rows that k are left when those with the query's own id are not counted.
    own = indexed.groupBy(F.col("vec_id").alias("query_id")).agg((F.count("*") + k).alias("least"))
    q = q.join(own, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(k)))

    @F.pandas_udf("array<int>")
    def leaves(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tree, held = sent.value
        for s, least in batches:
            yield pd.Series([tree.visits(np.asarray(v, np.float64), most, held, n) for v, n in zip(s, least)])

    visits = materialise(q.select("query_id", "v", F.explode(leaves("v", "least")).alias("leaf")), "ann-visits")
    parts = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    sizes = (indexed.groupBy("leaf").agg(F.count("*").alias("nx")).join(visits.groupBy("leaf").agg(F.count("*").alias("nq")), "leaf")
             .select("leaf", parts(F.col("nx"), block_rows).alias("bx"), parts(F.col("nq"), block_queries).alias("bq")))
    # A leaf's rows and queries meet in bx * bq blocks; sizes has one row per leaf of a tree of bounded size.
    blocks = F.broadcast(sizes)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (visits.join(blocks, "leaf").withColumn("cq", F.pmod(F.xxhash64("query_id"), F.col("bq")).cast("int")).withColumn("cx", every("bx"))
            .select("leaf", "cx", "cq", "query_id", "v"))
    right = (indexed.join(blocks, "leaf").withColumn("cx", F.pmod(F.xxhash64("vec_id", "v"), F.col("bx")).cast("int")).withColumn("cq", every("bq"))
             .select("leaf", "cx", "cq", "vec_id", "v"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = list(nearest(_matrix(a["v"]), a["query_id"].to_numpy(), _matrix(b["v"]), b["vec_id"].to_numpy(), k))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ["leaf", "cx", "cq"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
