"""Quality rules and ranked search against plain versions, and on odd rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.llm import quality, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    again = {i + j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(again),
            len(lines), sum("A" <= c <= "Z" for c in text))


def test_measures():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b ", "é", "A", "#", "\n", " ", " ", "\x0b", "\x85", "c d e f g h i j k ", "😀"]) for _ in range(rnd.randint(0, 60)))
        assert quality.measure(text.encode()) == plain_measure(text), repr(text)
    assert quality.measure(None) == quality.measure(b"") == (0,) * 7


def test_sketches_merge_and_bound_quantiles(spark):
    """Parts added up are the sketch of the whole, and quartiles are right to 1/32."""
    rnd = random.Random(3)
    values = [int(rnd.paretovariate(1.1) * 50) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").select(F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit("x").alias("rate"), quality._bucket(F.col("v")).alias("bucket"))
    whole = df.groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))
    halves = [df.filter(F.col("bucket") % 2 == r).groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n")) for r in (0, 1)]
    both = quality.merged(halves[0].unionByName(halves[1]).unionByName(halves[0]), ["lang", "source"])
    assert {(r.bucket, r.n) for r in quality.merged(whole, ["lang", "source"]).filter("bucket % 2 = 1").collect()} <= {(r.bucket, r.n) for r in both.collect()}
    q = quality.quartiles(whole, ["lang", "source"]).first()
    values.sort()
    for got, at in ((q.q1, 1), (q.q3, 3)):
        want = values[math.ceil(len(values) * at / 4) - 1]
        assert abs(got - want) <= max(1, want / 32)


def test_groups_set_their_own_limits(spark):
    """A source that always shouts keeps its texts; one shouting text elsewhere goes; small sources take their language's limits."""
    calm, loud = "some quiet words of a plain text " * 4, "SOME LOUD WORDS OF A PLAIN TEXT " * 4
    uniq = lambda t, i: " ".join(f"{w}{chr(97 + (i + j) % 26)}{chr(97 + j % 26)}" for j, w in enumerate(t.split()))
    rows = [(i, uniq(calm, i), "en", "calm") for i in range(150)] + [(200 + i, uniq(loud, i), "en", "loud") for i in range(150)]
    rows += [(900, uniq(loud, 1), "en", "calm"), (901, uniq(loud, 1), "de", None), (902, uniq(calm, 1), "de", None), (903, "too short", "en", "loud")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judged(df).collect()}
    assert not kept[900] and not kept[903] and all(kept[i] for i in range(150)) and all(kept[i] for i in range(200, 350))
    assert {r.doc_id for r in quality.filtered(df).collect()} == {i for i, k in kept.items() if k}


def test_quality_of_odd_rows(odd, empty):
    df = odd.withColumn("lang", F.lit(None).cast("string")).withColumn("group_l", F.lit("x")).withColumn("n_words", F.lit("x")).withColumn("m", F.lit("x"))
    got = quality.judged(df).collect()
    assert len(got) == df.count() and sum(r.n_words == 0 for r in got) == 4
    out = quality.filtered(df)
    assert out.columns == df.columns
    assert quality.judged(df.limit(0)).count() == quality.filtered(df.limit(0)).count() == 0


def plain_search(docs, items, k):
    bags = [(d, Counter(TERM.findall((t or "").translate(FOLD)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = set()
    for item, text in items:
        found = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 12 * m)) for t in TERM.findall((text or "").translate(FOLD)) if b[t])
            if s > 0:
                found.append((-s, d))
        out |= {(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("block_terms", [200_000, 40])
def test_search(spark, block_terms):
    rnd = random.Random(7)
    vocab = ["Alpha", "beta", "été", "x" * 90, "γ", "d1", "zz", "q", "w", "the", "of"] + [f"w{i}" for i in range(40)]
    text = lambda n: "".join(rnd.choice(vocab[:11] * 3 + vocab) + rnd.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 30))) for i in range(300)] + [(1000 + i, "same beta text") for i in range(30)] + [(2000, None), (2001, "")]
    items = [(i, text(rnd.randint(1, 12))) for i in range(25)] + [(99, "!!"), (98, None), (97, "beta"), (96, "nowhere")]
    got = search.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), 7, block_terms)
    assert {tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()} == plain_search(docs, items, 7)


def test_mined_nodes_spell_the_items():
    rnd = random.Random(4)
    items = [[f"t{rnd.randint(0, 12)}".encode() for _ in range(rnd.randint(1, 15))] for _ in range(60)]
    items += items[:10]
    leaves, inner, nodes = search.mine(items)

    def spelt(x):
        return [leaves[x]] if x < len(leaves) else spelt(inner[x - len(leaves)][0]) + spelt(inner[x - len(leaves)][1])
    assert [sorted(t for x in row for t in spelt(x)) for row in nodes] == [sorted(i) for i in items]
    pairs = Counter(p for row in nodes for p in zip(row, row[1:]))
    assert not pairs or max(pairs.values()) == 1
    assert inner and sum(map(len, nodes)) + len(inner) < sum(map(len, items))


def test_search_of_odd_rows(odd, empty):
    items = odd.select(F.col("doc_id").alias("item_id"), "text", "k", "n")
    got = search.ranked(odd, items).collect()
    assert {r.item_id for r in got} == {None, 1, 5, 6, 7, 8}
    assert sorted((r.rank, r.doc_id) for r in got if r.item_id == 7) == [(1, 7), (2, 8)]
    assert search.ranked(empty, items).count() == search.ranked(odd, items.limit(0)).count() == 0
