import random
from itertools import combinations

from barloom.llm import near
from barloom.llm.components import components


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(prev[j + 1] + 1, row[j] + 1, prev[j] + (x != y)))
        prev = row
    return prev[-1]


def test_banded_distance_equals_the_full_table():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        b = [x if rng.random() < .8 else rng.choice("abcd") for x in a] if rng.random() < .5 else [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        most, true = rng.randint(0, 14), distance(a, b)
        assert near.distance_within(a, b, most) == (true if true <= most else None)


def brute_groups(rows, similarity=0.8):
    """Components over all pairs of different texts, by doc_id."""
    words = {d: near.words_of(t) for d, t in rows}
    root = {d: d for d in words}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    runs = {d: {tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))} for d, w in words.items()}
    for a, b in combinations(sorted(words), 2):
        x, y = words[a], words[b]
        longest = max(len(x), len(y))
        most = int((1 - similarity) * longest + 1e-9)
        # With at most `most` edits all but two word pairs per edit are shared.
        if find(a) != find(b) and abs(len(x) - len(y)) <= most and len(runs[a] & runs[b]) >= len(runs[a]) - 2 * most - 1 \
                and near.distance_within(x, y, most) is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in words}


def test_groups_equal_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc: r.group_id for r in near.groups(docs).collect()}
    assert got == brute_groups(rows)
    assert len(set(got.values())) < len(got)


def test_a_large_group_of_copies_and_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(150)]
    rows = [(i, " ".join(base)) for i in range(150)]
    for i in range(150, 400):
        w = list(base)
        for _ in range(6):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 99999)}"
        rows.append((i, " ".join(w)))
    shared = " ".join(f"s{i}" for i in range(45))
    rows += [(i, shared + " " + " ".join(f"u{rng.randint(0, 10 ** 9)}" for _ in range(60))) for i in range(400, 700)]
    got = {r.doc: r.group_id for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert {got[i] for i in range(400)} == {0}
    assert all(got[i] == i for i in range(400, 700))  # they share a passage and no more


def test_near_copies_among_many_texts_that_share_a_passage(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(78)]
    own = lambda: [f"u{rng.randint(0, 10 ** 9)}" for _ in range(22)]
    rows = [(i, " ".join(passage + own())) for i in range(400)]
    for i in range(400, 440, 2):
        a = own()
        rows += [(i, " ".join(passage + a)), (i + 1, " ".join(passage + [w if j % 2 else f"z{i}-{j}" for j, w in enumerate(a)]))]
    got = {r.doc: r.group_id for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: i - i % 2 if i >= 400 else i for i in range(440)}  # pairs share no run outside the passage


def test_similar_texts_share_a_rarest_word():
    rng = random.Random(6)
    for _ in range(2000):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 25))]
        b = [x if rng.random() < .9 else rng.choice("abcdefghij") for x in a if rng.random() < .95]
        h = [near.run_hashes(near.word_hashes(w, {}), 1) for w in (a, b) if w]
        counts = near.np.zeros(near.SLOTS, near.np.int64)
        for x in h:
            near.np.add.at(counts, near._slots(x), 1)
        if b and near.similar(" ".join(a), " ".join(b), 0.8):
            assert set(near.rarest(h[0], counts, 0.8)) & set(near.rarest(h[1], counts, 0.8))


def test_odd_rows(spark, odd, empty):
    got = near.groups(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.root, []).append(r)
    sizes = sorted(len(v) for v in by.values())
    assert sizes == [1, 1, 2, 2, 2, 4]  # id 1 twice, the long texts, "word" twice, and the four without words
    assert near.groups(empty).count() == 0
    kept = near.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == 6


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))
