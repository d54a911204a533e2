"""Mixing, fingerprints, sentence spans, preference pairs, neighbours and the pipeline, against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from barloom.llm import fingerprints, mixing, neighbours, preference, q_llm, sentences

SF = "/root/testdata/sf0.001"


# ---- mixing

def plain_targets(sizes, limit=3, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        t = {s: limit * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in open_) for s in names}
        over = {s for s in open_ if t[s] > limit * sizes[s]}
        if not over:
            return t
        full |= over


def test_targets_and_words_taken(spark):
    rows = [(i, "w " * (i % 90 + 1), f"s{i % 7}" if i % 5 else "s0") for i in range(900)] + [(9000 + i, "x y", "tiny") for i in range(3)] + [(9100, "n " * 500, None)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=8, shard_slots=64)
    got = mixing.words_taken(m).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = plain_targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 8 for s in sizes)
    again = mixing.words_taken(mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(9), block_words=8, shard_slots=64))
    assert sorted(map(tuple, again.select("doc_id", "taken").collect())) == sorted((r.doc_id, r.taken) for r in got)


def test_permutation(spark):
    for n in (1, 2, 7, 64, 101):
        df = spark.range(n).selectExpr("0L sid", "0L copy", f"{n}L n_blocks", "id index")
        assert sorted(r["index"] for r in mixing.permuted(df, 5).collect()) == list(range(n))


def test_mixed_texts_hold_the_words_taken(spark, docs):
    m = mixing.mix(docs, block_words=16)
    got = Counter()
    for r in mixing.mixed_documents(docs, m).collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert +got == +Counter({r.doc_id: r.taken for r in mixing.words_taken(m).collect()})


def test_mixing_odd_rows(odd, empty):
    docs = odd.withColumn("source", odd["k"]).drop("k")
    got = mixing.words_taken(mixing.mix(docs)).collect()
    assert len(got) == odd.count() and sum(r.taken for r in got if r.size == 0) == 0
    assert mixing.mixed_documents(docs, mixing.mix(docs)).columns == docs.columns
    none = docs.limit(0)
    assert mixing.words_taken(mixing.mix(none)).count() == 0 and mixing.mixed_documents(none, mixing.mix(none)).count() == 0


# ---- fingerprints

def test_fingerprints_and_edits(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in q_llm.QUERIES["op10_simhash"](spark, SF).collect()}
    by_text = {}
    for i, (d, t) in enumerate(rows):
        cut, after = len(t) // 4, rows[(i + 1) % len(rows)]
        edited = t[:len(t) - cut] + after[1][:cut]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint
        differ = bin(int(got[d].fingerprint, 16) ^ int(got[after[0]].fingerprint, 16)).count("1")
        assert got[d].near_next == 1 - differ / 64
    fps = {d: int(r.fingerprint, 16) for d, r in got.items()}
    for d in fps:
        want = sum(bin(fps[d] ^ f).count("1") <= 3 for f in fps.values()) - 1 if d % 50 == 0 else None
        assert got[d].near_docs == want
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > .95


def test_all_fingerprints_within_the_radius(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-2 ** 63, 2 ** 63 - 1, 40)]
    fps = list(base)
    for b in base:
        for n in range(1, 6):
            x = b & (1 << 64) - 1
            for bit in rng.choice(64, n, replace=False):
                x ^= 1 << int(bit)
            fps.append(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {(r.query_fp, r.fp): r.distance for r in fingerprints.within_radius(df, df.limit(40)).collect()}
    asked = {r.fp for r in df.limit(40).collect()}
    far = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert got == {(a, b): far(a, b) for a in asked for b in set(fps) if far(a, b) <= 3}


def test_fingerprints_of_odd_rows(odd, empty):
    got = fingerprints.fingerprints_of_edits(odd).collect()
    assert len(got) == odd.count()
    assert all(r.fp == 0 for r in got if r.n_chars == 0) and len({r.fp for r in got if r.doc_id in (7, 8)}) == 1
    assert fingerprints.fingerprints_of_edits(empty).count() == 0
    one = fingerprints.fingerprints_of_edits(odd.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].fp == one[0].next_fp


# ---- sentence spans

def plain_spans(rows, min_words=20, lone_words=50):
    """Kept text by doc_id, with every run compared as text."""
    seen, gone, cut = {}, {}, {}
    for d, t in rows:
        cut[d] = sentences.split_sentences(t)
        words = [s.split() for s in cut[d]]
        n = len(words)
        count = lambda i, j: sum(map(len, words[i:j]))
        enough = lambda i, j: count(i, j) >= lone_words or count(i, j) >= min_words and j - i >= 2
        spans = set()
        for i in range(n):
            spans |= {(i, j) for j in [next((j for j in range(i + 1, n + 1) if enough(i, j)), None)] if j}
            spans |= {(k, i + 1) for k in [next((k for k in range(i, -1, -1) if enough(k, i + 1)), None)] if k is not None}
        for i, j in spans:
            seen.setdefault(" ".join(w for s in words[i:j] for w in s), []).append((d, i, j))
    for places in seen.values():
        for d, i, j in sorted(places)[1:]:
            gone.setdefault(d, set()).update(range(i, j))
    return {d: "".join(s for k, s in enumerate(c) if k not in gone.get(d, ())) for d, c in cut.items()}


def test_spans_equal_the_plain_version(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in q_llm.QUERIES["op3_sentence_spans"](spark, SF).collect()}
    want = plain_spans(rows)
    assert {d: r.text for d, r in got.items()} == want and sum(r.removed_sentences for r in got.values()) > 0


def test_shared_passages_go_and_the_rest_stays(spark, monkeypatch):
    passage = "Here is a passage. It has many words in it, more than fifty of them in all. " + "Short one. " * 3 + "And so it goes on and on until the count is reached, which takes a while, and then it ends at last."
    rows = [(i, f"Own start number {i} of this text.\n{passage}\nOwn end {i}.") for i in range(60)]
    long = " ".join(f"w{i}" for i in range(55)) + "."
    rows += [(100, f"Alone A.\n{long}"), (101, f"Alone B.\n{long}\nTail."), (102, "The. Of. And. The. Of. And.")]
    monkeypatch.setattr(sentences, "BATCH_RUNS", 50)
    got = {r.doc_id: r.text for r in sentences.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got[0] == rows[0][1] and got[100] == rows[60][1] and got[102] == rows[62][1]
    assert all(got[i] == f"Own start number {i} of this text.\nOwn end {i}." for i in range(1, 60)) and got[101] == "Alone B.\nTail."


def test_passages_in_mid_sentence_and_without_marks_go(spark):
    rng = random.Random(8)
    own = lambda i, n: " ".join(f"o{i}-{rng.randint(0, 10 ** 9)}" for _ in range(n))
    marked = [f"Six words stand in this. {' '.join(f'm{j}' for j in range(47))}."]
    plain = [" ".join(f"q{k}-{j}" for j in range(51)) for k in range(12)]
    rows = [(2 * k + i, f"{own(i, 30)} {p} {own(i, 30)}") for k, p in enumerate(marked + plain) for i in range(2)]
    got = {r.doc_id: r for r in sentences.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        if d % 2 == 0:
            assert got[d].text == text and got[d].removed_words == 0
        else:
            assert got[d].removed_words >= 20 and [w for w in got[d].text.split() if w.startswith("o1")] == [w for w in text.split() if w.startswith("o1")]
    text = "He said \"so.\"  Then (he left.) Gone.\n\nNew " + own(9, 90)
    assert "".join(sentences.split_sentences(text)) == text
    assert sentences.split_sentences(text)[:3] == ["He said \"so.\"  ", "Then (he left.) ", "Gone.\n\n"]
    assert max(len(s.split()) for s in sentences.split_sentences(text)) <= sentences.CUT_WORDS


def test_spans_of_odd_rows(odd, empty):
    got = sentences.deduplicated(odd)
    assert got.columns == [*odd.columns, "n_sentences", "removed_sentences", "removed_words"]
    by = {(r.doc_id, r.text) for r in got.collect()}
    assert got.count() == odd.count() and (2, None) in by and (3, "") in by and (1, "a b c d e f g") in by
    assert len(next(r.text for r in got.collect() if r.doc_id == 6)) < 200
    assert sentences.deduplicated(empty).count() == 0


# ---- preference

def test_preference_against_sql(spark):
    from check_oracle import compare, connect
    res = compare(spark, connect(SF), SF, "op9_preference", q_llm.QUERIES["op9_preference"], q_llm.ORACLE["op9_preference"])
    assert res.startswith("ok"), res


def test_preference_rows(spark):
    turns = [(1, 0, "user", "hi", "e"), (1, 1, "assistant", "yes", "e"), (1, 2, "user", "more", "e"), (1, 2, "user", "more", "e"),
             (2, 0, "user", "hi", "e"), (2, 1, "assistant", "n<|o", "e"), (2, 2, None, None, "e"), (3, 0, "user", "hi", "e")]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, pair_id string")
    pairs = spark.createDataFrame([(10, 1, 2), (11, 1, 3), (12, 1, 1), (13, 1, None), (14, 99, 98)], "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: r for r in preference.preference_rows(pairs, t).collect()}
    hi, yes, more = "<|user|>\nhi<|end|>\n", "<|assistant|>\nyes<|end|>\n", "<|user|>\nmore<|end|>\n"
    assert got[10].prompt == hi and got[10].chosen == yes + more and got[10].rejected == "<|assistant|>\nn< |o<|end|>\n<|user|>\n<|end|>\n"
    a, b = map(int, got[10].chosen_spans.split("-"))
    assert got[10].chosen[a:b] == "yes<|end|>"
    assert got[11].prompt == hi and got[11].rejected == "" and got[11].rejected_spans == ""
    assert got[12].n_prompt_turns == 3 and got[12].chosen == got[12].rejected == ""
    assert got[13].prompt == "" and got[13].chosen == hi + yes + more and got[14].chosen == ""
    assert preference.preference_rows(pairs.limit(0), t).count() == 0
    n = preference.formatted(preference.neighbour_pairs(t)).collect()
    assert {(r.chosen_id, r.rejected_id) for r in n} == {(None, 1), (2, 3)}


# ---- neighbours

def test_neighbours_recall_and_exact_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got = q_llm.QUERIES["op5_nearest"](spark, "/root/testdata/sf0.1").toPandas()
    p = rows.toPandas()
    x, ids = np.stack(p["embedding"].to_numpy()).astype(float), p["vec_id"].to_numpy()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and np.allclose(mine["score"], [d[ids == v][0] for v in mine["vec_id"]], atol=1e-12)
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(mine["vec_id"]))
        total += 10
    assert hit / total >= .9


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1., 0.]), (1, [1., 0.]), (2, [1., 0.]), (3, [0., 1.]), (4, None), (5, [0., 0.]), (6, [nan, 1.]), (7, [inf, 1.]), (8, [None, 1.]), (9, []),
         (10, [1., 2., 3.]), (None, [1., 0.]), (100, [0., 2.]), (100, [0., 2.])]
    df = spark.createDataFrame([(*r, "e") for r in v], "vec_id long, embedding array<double>, leaf string")
    got = [tuple(r) for r in neighbours.search(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 100), (0, 5, 100), (100, 1, 3), (100, 2, 0), (100, 3, 1), (100, 4, 2)]
    assert got[0][3] == 0 and got[5][3] == 1
    assert neighbours.search(df.limit(0), df).count() == 0
    many = spark.createDataFrame([(i, [1., 1.]) for i in range(3000)] + [(5000, [4., 4.])], "vec_id long, embedding array<double>")
    hot = neighbours.search(many, many.filter("vec_id = 5000"), block_rows=100, block_queries=1).orderBy("rank").collect()
    assert [r.vec_id for r in hot] == list(range(10))


# ---- pipeline

def test_pipeline(spark, docs):
    import corpus_pipeline as c
    assert [n for n, _ in c.STAGES] == ["toxicity", "near_duplicates", "sentence_spans", "mixing", "bpe"] and c.ORACLE_SQL is None
    from test_near import brute_groups
    kept, toxic = docs, None
    for name, stage in c.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in kept.collect()]
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        after = [(r.doc_id, r.text) for r in kept.collect()]
        if name == "near_duplicates":
            assert {d for d, _ in after} == set(brute_groups(before).values())
        if name == "sentence_spans":
            assert {d: t for d, t in after} == {d: t for d, t in plain_spans(sorted(before)).items() if t.strip() or not dict(before)[d].strip()}
        assert kept.columns == docs.columns and after
    assert c.STAGES[-1][1](spark, kept, SF).count() == kept.count()
    assert c.run(spark, SF).count() == kept.count()
    for _, stage in c.STAGES:
        stage(spark, docs.limit(0), SF).count()


def test_neighbour_pairs_of_large_ids(spark):
    """Ids beyond 2**53 keep to their own pair, below zero as well."""
    from barloom.llm import preference
    ids = [2 ** 53 + 2, 2 ** 53 + 3, 2 ** 53 + 4, 2 ** 53 + 5, -1, -2, 0, 1]
    df = spark.createDataFrame([(i, 0, "user", f"t{i}") for i in ids], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: (r.chosen_id, r.rejected_id) for r in preference.formatted(preference.neighbour_pairs(df)).collect()}
    assert got == {i // 2: (i, i + 1) for i in ids if i % 2 == 0}


def test_neighbours_of_few_ids(spark):
    """Three ids, and three vectors, that fill a table beyond the sample: all candidates are found all the same."""
    rng = np.random.default_rng(3)
    own = [(i % 3, rng.normal(size=4).tolist()) for i in range(600)]
    same = [(i, [float(i % 3), 1.0]) for i in range(600)]
    for rows in (own, same):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = neighbours.search(df, df.filter("vec_id < 2"), k=5, sample_rows=20).collect()
        for q in (0, 1):
            firsts = {}
            for i, v in rows:
                firsts.setdefault(i, []).append(v)
            best = sorted((float(np.sqrt(((np.array(v) - np.array(min(firsts[q]))) ** 2).sum())), i) for i, v in rows if i != q)[:5]
            assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in best]
