"""Near-duplicates by Order MinHash and banded alignment.

A text is its words in lower case. Of its runs of k words, each labelled with how often it came before in the text, every one of `sketches` hash
functions takes the `order` smallest; in text order they make one sketch, so texts share sketches if they share runs in the same order, which
follows edit similarity (Marçais et al. 2019). Texts with equal words form a class, handled as one node. Nodes that share a sketch
are candidates, and a pair is linked if the word-level edit distance is at most (1 - similarity) times the longer length. The
distance is taken by bit-parallel alignment within the band that the limit allows, after common ends are cut off. A group is a connected component of links.

Inside a sketch's bucket no pairs are listed. Each node is aligned with the bucket's smallest node first; pairs that earlier links already join are
skipped. In `rounds` further rounds, the components that still meet in a bucket are put in order of length, and neighbours are aligned. A third of all
rows in one group of copies thus costs a pair or a few per node. What buckets still hold several components is then followed up without loss: texts within
the limit of e edits share all but e of the longer one's labelled words, so under any common order of words they share one of their first e + 1. With
the rarest words first, nodes of a bucket that share such a word are its sub-bucket, and there all pairs between components are aligned. Every two texts
that share a sketch and are similar thus end in one group.

Defined results: null, empty and blank texts are one class. A text of fewer than k words is one run. A null doc_id comes first. Rows equal in all columns are one
document of the same group. The group's id is its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import materialise, only
from barloom.llm.components import components

NO_ID = -(1 << 63)
MEMO = 400_000
#: Slots in which words are counted to tell rare from common ones. Words that share a slot only count as more common.
SLOTS = 1 << 18


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of runs of k words, labelled with their occurrence; of fewer words, one run."""
    n = max(1, len(words) - k + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(min(k, len(words))):
            h = (h ^ words[j:j + n]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        if len(new) < n:
            times = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
            h[order] += times.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return h


def sketches_of(h: np.ndarray, m: int, order: int) -> np.ndarray:
    """m sketches of labelled run hashes: for each hash function its `order` smallest runs in text order."""
    out = np.empty(m, np.uint64)
    order = min(order, len(h))
    with np.errstate(over="ignore"):
        for i in range(m):
            x = (h ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
            at = np.sort(np.argpartition(x, order - 1)[:order])
            v = np.uint64(i + 1)
            for a in at:
                v = (v ^ h[a]) * np.uint64(0x94D049BB133111EB)
                v ^= v >> np.uint64(32)
            out[i] = v
    return out


def distance_within(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if at most `most`, else None. Columns of the alignment are bit vectors of the 2 * most + 1 rows of the band."""
    lo = 0
    short = min(len(a), len(b))
    while lo < short and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < short - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo:len(a) - end], b[lo:len(b) - end]
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return None
    if not m or not n:
        return m + n
    d = min(most, max(m, n))
    rows: dict = {}
    for i, w in enumerate(a):
        rows[w] = rows.get(w, 0) | 1 << i
    width = 2 * d + 1
    full = (1 << width) - 1
    # Bit r of column j stands for row j - d + r (from 0). Rows above the text have no rise, those below it rise by one.
    up, down = full ^ ((1 << d) - 1), 0
    first, last = -d, 1 << width - 1
    at, row = (d, width - 2) if m > d else (m, m - 1 + d)
    for j in range(n):
        x = rows.get(b[j], 0)
        x = (x >> first if first >= 0 else x << -first) & full
        same = (((x & up) + up) ^ up | x | down) & full
        right = down | full ^ (same | up)
        left = same & up
        if j < m - d:  # along the lower edge of the band, until it meets the last row
            at += not same & last
        else:
            at += (right >> row & 1) - (left >> row & 1)
            row -= 1
        same >>= 1
        down = same & right
        up = left | full ^ (same | right)
        first += 1
    return at if at <= most else None


def similar(a: str | None, b: str | None, similarity: float) -> bool:
    x, y = words_of(a), words_of(b)
    longest = max(len(x), len(y))
    most = int((1 - similarity) * longest + 1e-9)
    return abs(len(x) - len(y)) <= most and distance_within(x, y, most) is not None


def word_hashes(words: list[str], memo: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; memo keeps up to MEMO of them."""
    out = []
    for w in words:
        v = memo.get(w)
        if v is None:
            if len(memo) >= MEMO:
                memo.clear()
            memo[w] = v = xxhash.xxh3_64_intdigest(w)
        out.append(v)
    return np.array(out, np.uint64)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def rarest(h: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """Of a text's labelled words the rarest, as many as two similar texts can't both have apart, without those that no other text has."""
    c = counts[_slots(h)]
    first = np.lexsort((h, c))[:int((1 - similarity) * len(h) + 1e-9) + 1]
    return h[first[c[first] > 1]]


def _rare_words(texts: DataFrame, similarity: float) -> DataFrame:
    """node and rare (its rarest labelled words) of texts: node, text. A table of SLOTS counts comes to the driver."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, memo = np.zeros(SLOTS, np.int64), {}
        for pdf in batches:
            for text in pdf["text"]:
                np.add.at(total, _slots(run_hashes(word_hashes(words_of(text), memo), 1)), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at.astype(np.int32), "c": total[at]})

    held = texts.select("text").mapInPandas(count, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(SLOTS, np.int64)
    counts[held["slot"].to_numpy()] = held["c"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "rare": [rarest(run_hashes(word_hashes(words_of(t), memo), 1), sent.value, similarity).view(np.int64)
                                                              for t in pdf["text"]]})

    return texts.select("node", "text").mapInPandas(rare, "node binary, rare array<long>")


def _apart(here: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes that meet in a bucket, lie in different components and may be similar by length and rarest words. here: key, a, n, root_a."""
    several = here.groupBy("key").agg(F.min("root_a").alias("lo"), F.max("root_a").alias("hi")).filter("lo <> hi").select("key")
    left = materialise(here.join(several, "key"), "near-left")
    wanted = left.select(F.col("a").alias("node")).distinct()
    rare = materialise(_rare_words(texts.join(wanted, "node", "left_semi"), similarity), "near-rare")
    sub = (left.join(rare, left["a"] == rare["node"]).select("a", "n", "root_a", "key", F.explode("rare").alias("word"))
           .select(F.xxhash64("key", "word").alias("sub"), "a", "n", "root_a"))
    dealt = materialise(sub, "near-sub")
    met = dealt.groupBy("sub").agg(F.min("root_a").alias("lo"), F.max("root_a").alias("hi")).filter("lo <> hi").select("sub")
    x = materialise(dealt.join(met, "sub", "left_semi"), "near-submet")
    y = x.select("sub", F.col("a").alias("b"), F.col("n").alias("m"), F.col("root_a").alias("root_b"))
    long, short = F.greatest("n", "m"), F.least("n", "m")
    return (x.join(y, "sub").filter((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & (long - short <= F.floor((1 - similarity) * long + 1e-9)))
            .select("a", "b").distinct())


def sketched(docs: DataFrame, k: int, m: int, order: int) -> DataFrame:
    """doc, th, node (a digest of the words), n (words) and sk (sketches) per row of docs: doc, th, text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                words = words_of(text)
                node = xxhash.xxh3_128_digest(" ".join(words))
                if not words:
                    rows.append((node, 0, None))
                    continue
                h = run_hashes(word_hashes(words, memo), k)
                rows.append((node, len(words), sketches_of(h, m, order).view(np.int64)))
            yield pd.DataFrame({"doc": pdf["doc"], "th": pdf["th"], "node": [r[0] for r in rows], "n": [r[1] for r in rows], "sk": [r[2] for r in rows]})

    return docs.select("doc", "th", "text").mapInPandas(run, "doc long, th long, node binary, n int, sk array<long>")


def _aligned(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose texts are similar."""
    @F.pandas_udf("boolean")
    def ok(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(s, t, similarity) for s, t in zip(x, y)])

    p = materialise(pairs.select("a", "b"), "near-pairs")
    t = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"), F.col("n").alias(f"n_{c}"))
    long, short = F.greatest("n_a", "n_b"), F.least("n_a", "n_b")
    q = (p.join(t("a"), "a").join(t("b"), "b").filter(long - short <= F.floor((1 - similarity) * long + 1e-9)).filter(ok("text_a", "text_b")))
    return materialise(q.select("a", "b"), "near-links")


def _next_in_order(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of neighbours of one key, rows (key, n, a) being in order. All keys are put in order together and dealt out by range, so that a key with many
    rows is many ranges; a range's last row meets the first of the next range."""
    dealt = materialise(rows.repartitionByRange("key", "n", "a").withColumn("part", F.spark_partition_id()), "near-order")
    least = dealt.groupBy("part").agg(F.min(F.struct("key", "n", "a")).alias("x"))
    follow = least.select("part", F.lead("x").over(Window.orderBy("part")).alias("y"))
    inside = Window.partitionBy("part").orderBy("key", "n", "a")
    after = F.coalesce(F.lead(F.struct("key", "n", "a")).over(inside), F.col("y"))
    return dealt.join(follow, "part").withColumn("after", after).filter(F.col("after.key") == F.col("key")).select("a", F.col("after.a").alias("b"))


def groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, sketches: int = 32, order: int = 2, rounds: int = 2) -> DataFrame:
    """docs: doc_id, text. doc, th, root (least node of the group), group_id, group_size, first: a row per row of docs. doc is
    doc_id with NO_ID for null, th the text's hash."""
    d = only(docs, doc=F.coalesce("doc_id", F.lit(NO_ID)), text="text").withColumn("th", F.xxhash64("text"))
    rows = materialise(sketched(d, k, sketches, order), "near-sketches")
    # Few columns go through the first aggregation, where copies meet; a class's sketches are those of its least row.
    least = rows.groupBy("node").agg(F.min(F.struct("doc", "th")).alias("r"))
    nodes = materialise(rows.join(least, "node").filter((F.col("doc") == F.col("r.doc")) & (F.col("th") == F.col("r.th")))
                        .groupBy("node", "doc", "th", "n").agg(F.first("sk").alias("sk")), "near-nodes")
    buckets = materialise(nodes.select("node", "n", F.explode("sk").alias("key")), "near-buckets")
    shared = materialise(buckets.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("c")).filter("c > 1").select("key", "centre"), "near-shared")
    met = materialise(buckets.join(shared, "key").select("key", "node", "n", "centre"), "near-met")
    wanted = met.select("node").distinct().join(nodes.select("node", "doc", "th", "n"), "node")
    texts = materialise(d.join(wanted.hint("merge"), ["doc", "th"]).groupBy("node", "n").agg(F.first("text").alias("text")), "near-texts")

    apart = met.filter("node <> centre")
    one = apart.groupBy(F.col("node").alias("a")).agg(F.min("centre").alias("b"))
    links = _aligned(one, texts, similarity)
    roots = components(links)
    rooted = lambda f, c, r: f.join(r.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    others = rooted(rooted(apart.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "a", roots), "b", roots)
    # One pair between two components and a centre is enough to join them, but the other pairs may be needed if it fails: keep all that are still apart.
    tried = others.filter("root_a <> root_b").join(one, ["a", "b"], "left_anti")
    def with_more(pairs: DataFrame) -> bool:
        """Align pairs; take up their links and the components that come of them, if there are any."""
        nonlocal links, roots
        more = _aligned(pairs, texts, similarity)
        if not more.limit(1).count():
            return False
        links = links.union(more)
        roots = components(links)
        return True

    with_more(tried)
    for _ in range(rounds):
        here = (rooted(met.select("key", F.col("node").alias("a"), "n"), "a", roots)
                .groupBy("key", "root_a").agg(F.min(F.struct("n", "a")).alias("x")).select("key", "x.n", "x.a"))
        if not with_more(_next_in_order(here).distinct()):
            break
    # All that is still apart in a bucket; no pair of it is left out, so this needs no further round.
    with_more(_apart(rooted(met.select("key", F.col("node").alias("a"), "n"), "a", roots), texts, similarity))
    rooted_rows = materialise(rooted(rows.select("doc", "th", F.col("node").alias("a")), "a", roots).select("doc", "th", F.col("root_a").alias("root")), "near-rooted")
    of = materialise(rooted_rows.groupBy("root").agg(F.min(F.struct("doc", "th")).alias("least"), F.count("*").alias("group_size")), "near-groups")
    return (rooted_rows.join(of, "root")
            .select("doc", "th", "root", F.nullif("least.doc", F.lit(NO_ID)).alias("group_id"), "group_size",
                    ((F.col("doc") == F.col("least.doc")) & (F.col("th") == F.col("least.th"))).alias("first")))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """One row of docs for each group: the one with the smallest doc_id, of rows sharing it the one with the smallest text hash."""
    g = groups(docs, **how).filter("first").select(F.col("doc").alias("__doc"), F.col("th").alias("__th")).distinct()
    keyed = docs.withColumns({"__doc": F.coalesce(F.col("`doc_id`"), F.lit(NO_ID)), "__th": F.xxhash64("text")})
    return keyed.join(g.hint("merge"), ["__doc", "__th"]).dropDuplicates(["__doc", "__th"]).select(*[F.col(f"`{c}`") for c in docs.columns])
