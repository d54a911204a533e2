"""Conversation repair against exhaustive search, and on odd rows."""

import hashlib
import heapq
import random
import re

from barloom.llm import repair

FORM = re.compile(r"(s?(ua)+)?\Z")


def exhaustive(rows):
    """(cost, audit, repaired) of the least edits: all paths in order of (cost, audit), over rows done and roles so far."""
    n = len(rows)
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in out)
        if i == n and FORM.match(initials):
            return cost, audit, out
        if (i, out, audit) in done or cost > 3 * n:
            continue
        done.add((i, out, audit))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, (*out, (role, ""))))
        if i < n:
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out))
            if faults[i] not in ("b", "d"):
                t = faults[i] == "t"
                heapq.heappush(heap, (cost + t, audit + "K", i + 1, (*out, (role, text))))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + t + 2, audit + "R", i + 1, (*out, (r, text))))
    raise AssertionError


def test_least_edits(spark):
    rnd = random.Random(5)
    talks = {}
    for c in range(70):
        n = rnd.randint(1, 4)
        talks[c] = [(rnd.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rnd.choice(["Yes.", "no", "", "What?", "ok\n"])) for _ in range(n)]
    rows = [(c, t, r, x) for c, turns in talks.items() for t, (r, x) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repair.summaries(df).collect()}
    turns = {}
    for r in repair.repaired(df).collect():
        turns.setdefault(r.conv_id, []).append((r.step, r.role, r.text))
    for c, talk in talks.items():
        cost, audit, out = exhaustive(talk)
        assert (got[c].cost, got[c].audit) == (cost, audit), talk
        assert got[c].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
        assert [x[1:] for x in sorted(turns.get(c, []))] == list(out)


def test_undecided_edits_stay_few():
    """Edits are decided while rows still come in; where users alone speak, nothing can be decided, and time stays linear."""
    for roles, decided in ((["user", "assistant"], 2900), (["tool"], 2900), (["system"], 2900), (["user"], 0)):
        out = []
        walk = repair.Walk(lambda *e: out.append(e[0]))
        for i in range(3000 if decided else 100000):
            walk.add({"turn": i, "role": roles[i % len(roles)], "text": f"{i}.", "blank": False, "later": i % 5 < 2, "truncated": i % 3 == 0})
        assert len(out) >= decided
        walk.end()
        assert len(out) >= 3000


def test_ties_far_back():
    """A tie that lasts over many rows is settled by its first difference."""
    walk_out = []
    walk = repair.Walk(lambda *e: walk_out.append(e[0]))
    rows = [("assistant", "a."), *[("tool", f"{i}.") for i in range(5)], ("assistant", "z.")]
    for i, (r, x) in enumerate(rows):
        walk.add({"turn": i, "role": r, "text": x, "blank": False, "later": False, "truncated": False})
    cost = walk.end()
    assert (cost, "".join(walk_out)) == exhaustive(rows)[:2]


def test_odd_rows(spark):
    rows = [(None, None, None, None, "x"), (None, 1, "user", "Hi.", "x"), (1, None, "assistant", "b.", "x"), (1, None, "user", "a.", "x"), (1, 2, "user", "a.", "x"),
            (2, 5, "user", "q?", "x"), (2, 5, "user", "q?", "x"), (2, 9, "assistant", "long. " * 50000, "x"), (3, 1, "", "no role.", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, digest string")
    df = df.withColumn("first_at", df["digest"]).withColumn("later", df["digest"])
    got = {r.conv_id: r for r in repair.summaries(df).collect()}
    assert (got[None].blank, got[None].audit, got[None].cost) == (1, "DKI", 5)
    assert (got[1].duplicate, got[1].illegal) == (1, 1)
    assert (got[2].duplicate, got[2].audit, got[2].cost) == (1, "KDK", 3)
    assert (got[3].audit, got[3].cost) == ("D", 3)
    assert {r.conv_id: r.gaps for r in repair.gaps(df).collect()} == {None: 0, 1: 0, 2: 3, 3: 0}
    none = df.limit(0)
    assert repair.summaries(none).count() == repair.edits(none).count() == repair.damaged(none).count() == repair.gaps(none).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    import zlib
    got = {}
    for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: [], 1: [(role, "")], 2: [(role, text.translate({ord(x): None for x in ".!?"}))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(k, [(role, text)])
        assert got.get((c, t), []) == want
