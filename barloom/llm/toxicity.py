"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers in numpy are trained from confirmed toxic texts (positives) and plain texts of the corpus (unlabelled, toxic ones
among them) on the risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)):  the unlabelled risk of calling a text harmless, less the
part that its toxic share must cause, and never below zero; where a step finds it below zero, that step goes the other way
(Kiryo et al. 2017). Each of `models` classifiers trains in its own Spark task on its own share of the samples, and their
weights are averaged; scoring runs where the texts are.

Features are the distinct words of a text and the distinct beginnings of 4 to 7 letters of its words, over letters alone and in lower
case, kept if at least `min_df` different positive texts have them.

Bounds: at most `max_positive` toxic and `max_unlabelled` other texts, chosen by hash over the whole table, train the models;
`max_features` features. Every text is scored whole.

Defined results: a null or empty text has no features and scores as the bias says; a null doc_id is scored and trains as unlabelled; a doc_id labelled
twice is toxic if one label says so; null labels are skipped. Without positives every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Memo, only

LETTERS = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6, 7)


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STARTS if len(word) >= n)]


def features(text: str | None) -> set[str]:
    out: set[str] = set()
    for w in set(LETTERS.findall((text or "").lower())):
        out.update(word_features(w))
    return out


def nnpu_fit(p: list[np.ndarray], u: list[np.ndarray], n: int, prior: float, epochs: int = 200, rate: float = 0.05,
             l1: float = 0.25) -> tuple[np.ndarray, float]:
    """Weights and bias for rows of feature numbers below n. Full-batch Adam on the non-negative risk with logistic loss; a soft
    threshold after each step takes out weights whose gradient is within l1 times what chance gives so many positives."""
    def stacked(rows):
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        return (np.concatenate(rows) if rows else np.empty(0, np.int64)), np.repeat(np.arange(len(rows)), sizes), len(rows)

    pi, pr, np_ = stacked(p)
    ui, ur, nu = stacked(u)
    w, b = np.zeros(n), math.log(prior / (1 - prior))
    m, v, t = np.zeros(n + 1), np.zeros(n + 1), 0
    chance = l1 * prior / math.sqrt(max(1, np_))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for _ in range(epochs):
        zp = np.bincount(pr, w[pi], np_) + b
        zu = np.bincount(ur, w[ui], nu) + b
        sp, su = sig(zp), sig(zu)
        # Logistic loss: log(1 + exp(-z)) for toxic, log(1 + exp(z)) for harmless.
        below = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() < 0
        gp, gu = -prior * sp / np_, su / nu
        if below:
            gp, gu = -gp, -gu
        else:
            gp = gp - prior * (1 - sp) / np_
        grad = np.bincount(pi, gp[pr], n) + np.bincount(ui, gu[ur], n)
        full = np.append(grad, gp.sum() + gu.sum())
        t += 1
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full * full
        size = rate / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        step = size * m / (1 - 0.9 ** t)
        w, b = w - step[:n], b - step[n]
        w = np.sign(w) * np.maximum(np.abs(w) - size[:n] * chance, 0)
    return w, b


def fit_group(texts: list[str | None], positive: list[bool], prior: float, min_df: int, max_features: int) -> pd.DataFrame:
    """Features with their weights; the bias is the row without a feature."""
    seen: Counter = Counter()
    for t in {t for t, y in zip(texts, positive) if y}:
        seen.update(features(t))
    kept = sorted(((c, f) for f, c in seen.items() if c >= min_df), key=lambda x: (-x[0], x[1]))[:max_features]
    number = {f: i for i, (_, f) in enumerate(kept)}
    rows = lambda y: [np.fromiter((number[f] for f in features(t) if f in number), np.int64) for t, z in zip(texts, positive) if z == y]
    p, u = rows(True), rows(False)
    if not p or not u:
        return pd.DataFrame({"feature": [None], "weight": [0.0]})
    w, _ = nnpu_fit(p, u, len(number), prior)
    # The threshold also shrinks what it keeps: the kept features are fitted again without it.
    held = np.flatnonzero(w)
    place = np.full(len(number) + 1, -1)
    place[held] = np.arange(len(held))
    again = lambda rows: [place[r][place[r] >= 0] for r in rows]
    ws, b = nnpu_fit(again(p), again(u), len(held), prior, l1=0.0)
    w[held] = ws
    return pd.DataFrame({"feature": [None, *number], "weight": [b, *w]})


def train(docs: DataFrame, labels: DataFrame, models: int = 3, max_positive: int = 6000, max_unlabelled: int = 12000,
          min_df: int = 2, max_features: int = 50_000, smallest: float = 0.02) -> tuple[dict[str, float], float] | None:
    """docs: doc_id, text, those that may teach. labels: doc_id, toxic of confirmed texts. The class prior is the toxic share of the labels.

    Returns weights by feature and the bias, or None without positives. What comes to the driver is bounded by max_features * models."""
    lab = only(labels, doc_id="doc_id", toxic="toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = only(docs, doc_id="doc_id", text="text")
    s = lab.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("p"), F.count("*").alias("l")).first().asDict() | {"n": d.count()}
    if not s["p"] or not s["n"]:
        return None
    prior = min(0.5, max(1e-3, s["p"] / s["l"]))
    share = lambda k, of: F.lit(int(min(1.0, k / of) * (1 << 30)))
    draw = lambda *c: F.pmod(F.xxhash64(F.lit("nnpu"), *c), F.lit(1 << 30))
    h = F.xxhash64(F.lit("nnpu"), "doc_id", F.xxhash64("text"))
    # The drawn ids are about max_positive at most, so texts stay where they are.
    toxic = lab.filter((F.col("toxic") == 1) & (draw("doc_id") < share(max_positive, s["p"]))).select("doc_id")
    p = d.join(F.broadcast(toxic), "doc_id").select("text", F.lit(True).alias("positive"), h.alias("h"))
    u = d.filter(draw("doc_id", F.xxhash64("text")) < share(max_unlabelled, s["n"])).select("text", F.lit(False).alias("positive"), h.alias("h"))
    # Few positives go to every model, many are dealt out.
    every = F.array(*[F.lit(i) for i in range(models)])
    own = F.array(F.pmod(F.shiftright("h", 32), F.lit(models)).cast("int"))
    p = p.withColumn("model", F.explode(own if s["p"] > max_positive / 2 else every))
    u = u.withColumn("model", F.explode(own if s["n"] > max_unlabelled / 2 else every))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        out = fit_group(pdf["text"].tolist(), pdf["positive"].tolist(), prior, min_df, max_features)
        return out[out["feature"].isna() | (out["weight"].abs() > smallest)]

    rows = (p.unionByName(u).groupBy("model").applyInPandas(fit, "feature string, weight double")
            .groupBy("feature").agg((F.sum("weight") / models).alias("weight")).collect())
    weights = {r["feature"]: r["weight"] for r in rows}
    return {f: w for f, w in weights.items() if f is not None}, weights.get(None, 0.0)


def score(docs: DataFrame, model: tuple[dict[str, float], float] | None, cache_bytes: int = 24_000_000) -> DataFrame:
    """docs with a column `score`: the averaged classifier's probability. Other columns pass through."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = sent.value
        own = {f: f for f in weights}
        known = Memo(cache_bytes)

        def hits(word: str) -> tuple[str, ...]:
            # A feature's text belongs to the weights, a tuple only points at it.
            return known.keep(word, tuple(own[f] for f in word_features(word) if f in weights), 250 + 2 * len(word))

        def one(text: str | None) -> float:
            if text is None:
                return bias
            got: set[str] = set()
            for w in set(LETTERS.findall(text.lower())):
                f = known.get(w)
                if f is None:
                    f = hits(w)
                if f:
                    got.update(f)
            # Sorted: the sum must not depend on the order of a set.
            return bias + sum(weights[f] for f in sorted(got))

        for s in batches:
            z = np.array([one(t) for t in s])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    return docs.withColumn("score", run(F.col("`text`")))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0
