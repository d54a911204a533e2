"""Conversation repair: the cheapest edits that make the role initials of a conversation match (s?(ua)+)?, by a Viterbi walk with
survivor coalescence.

Rows are kept (0), given the role user or assistant (2), deleted (3), and empty user or assistant turns inserted (2). Blank rows and rows equal to
an earlier one must go; a truncated row that stays costs 1 more. Of equally cheap edits, the one whose initials K, R, D, I are least as a text wins.

Spark finds the faults, deals rows by conversation and sorts each partition; a partition is then walked as a stream. Four states (nothing yet,
behind s, u, a) each keep one survivor: a cost and a leaf of a tree of back pointers. Nodes count what points at them; a leaf that no state takes
over is freed up to its last shared ancestor. As soon as the root has a single branch, that edit is common to all survivors: it is emitted, hashed
and freed. A survivor goes when another one can imitate all its continuations more cheaply (`BRIDGE`), otherwise the path that deletes everything
would keep the root split forever. Two candidates of equal cost are compared over their whole suffixes behind their
last common ancestor. With equal cost none is a prefix of the other: it would differ by inserts alone, which cost something.

Memory of a task: the edits that are still undecided (texts of deleted rows are let go at once), and a byte per edit for the audit. Two states of nearly
equal cost stay undecided over a run of rows that must go, since only the next row that can stay tells them apart. Time is linear: paths that have parted hand their
order down. A walk is in order by nature, so one conversation is walked by one task, whatever its length, as a stream.

Defined results: rows go by turn, nulls first, then role and text. A null role or text counts as one space. A null conv_id is a conversation. Repeated
rows are duplicates. Extra columns are ignored. A conversation whose rows all go has an empty audit only if it had no rows. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from barloom.llm.common import only

SPACE = " \t\n\x0b\f\r"
ENDS = [".", "!", "?"]
NONE, S, U, A = range(4)
REROLE, DELETE, INSERT = 2, 3, 2
#: Where a state leads when a row is kept by its initial, and when a user or assistant turn is put there.
BY_INITIAL = {"s": {NONE: S}, "u": {NONE: U, S: U, A: U}, "a": {U: A}}
TURN = {NONE: U, S: U, A: U, U: A}
ROLE = {U: "user", A: "assistant"}
#: (strong, weak): what it costs at most to follow any continuation of weak from strong.
BRIDGE = {(A, NONE): DELETE, (A, S): 0, (A, U): INSERT, (U, A): INSERT, (U, S): INSERT, (U, NONE): INSERT + DELETE}


class Node:
    __slots__ = ("parent", "edit", "row", "depth", "kids", "held")

    def __init__(self, parent: Node | None, edit: str, row, linked: bool = True):
        self.parent, self.edit, self.row, self.kids, self.held = parent, edit, row, [], 0
        self.depth = parent.depth + 1 if parent else 0
        if parent and linked:
            parent.kids.append(self)


def free(node: Node) -> None:
    """Drops a node that nothing points at any more, and its ancestors up to one that is still in use."""
    while node.parent is not None and not node.kids and not node.held:
        up, node.parent = node.parent, None
        up.kids.remove(node)
        node = up


def parted(a: Node, b: Node) -> bool | None:
    """Whether a's path is less than b's, from their last common ancestor on; None where one is the beginning of the other."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edit)
            a = a.parent
        else:
            right.append(b.edit)
            b = b.parent
    return left[::-1] < right[::-1] if left and right else None


class Walk:
    """One conversation. `emit` gets every edit once it is decided: (edit, row or None, role, text), role None for deletions."""

    def __init__(self, emit):
        self.emit, self.root, self.state = emit, Node(None, "", None), NONE
        self.root.held = 1
        self.best: dict[int, tuple[int, Node]] = {NONE: (0, self.root)}
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.known: dict[tuple[Node, Node], bool] = {}
        self.initial: str | None = None
        self.seen: tuple | None = None

    def _before(self, a: Node, x: str, b: Node, y: str) -> bool:
        """Whether a's path and then x is less than b's and then y."""
        if a is b:
            return x < y
        less = self.known.get((a, b))
        if less is not None:
            return less
        return parted(Node(a, x, None, linked=False), Node(b, y, None, linked=False)) is True

    def _orders(self, nodes: list[Node]) -> dict[tuple[Node, Node], bool]:
        """Orders of survivors. Paths that have parted keep their order, so it is handed down; only new forks are compared by their suffixes."""
        out = {}
        for n, m in combinations(nodes, 2):
            less = next((self.known[k] for k in ((n, m), (n.parent, m.parent), (n.parent, m), (n, m.parent)) if k in self.known), None)
            less = parted(n, m) if less is None else less
            if less is not None:
                out[n, m], out[m, n] = less, not less
        return out

    def _hold(self, chosen: dict[int, tuple[int, Node]]) -> None:
        self.known = self._orders([n for _, n in chosen.values()])
        for _, n in chosen.values():
            n.held += 1
        for _, n in self.best.values():
            n.held -= 1
        for _, n in self.best.values():
            free(n)
        self.best = chosen
        while len(self.root.kids) == 1 and not self.root.held:
            self.root = self.root.kids[0]
            self.root.parent = None
            self._decide(self.root)

    def _decide(self, node: Node) -> None:
        if node.edit == "D":
            return self.emit("D", node.row, None, None)
        if node.edit == "K":
            self.state = BY_INITIAL[node.row["role"][:1]][self.state]
            return self.emit("K", node.row, node.row["role"], node.row["text"])
        self.state = TURN[self.state]
        self.emit(node.edit, node.row, ROLE[self.state], node.row["text"] if node.row else "")

    def _better(self, now: tuple | None, cost: int, node: Node, edit: str) -> bool:
        return now is None or cost < now[0] or cost == now[0] and self._before(node, edit, now[1], now[2])

    def _inserts(self) -> None:
        """Puts turns in where that is cheaper than what the state has; two in a row reach from nothing to behind an assistant."""
        for to in (U, A):
            now = self.best.get(to)
            top = now and (now[0], now[1], "")
            for state, (cost, node) in self.best.items():
                if TURN[state] == to and self._better(top, cost + INSERT, node, "I"):
                    top = (cost + INSERT, node, "I")
            if top and top[2]:
                self._hold(self.best | {to: (top[0], Node(top[1], "I", None))})

    def add(self, row: dict) -> None:
        """row: role, text, blank, later (an earlier turn has its role and text), truncated, turn."""
        key = (row["turn"], row["role"], row["text"])
        duplicate = not row["blank"] and (row["later"] or key == self.seen)
        truncated = not row["blank"] and not duplicate and row["truncated"]
        for name, hit in (("blank", row["blank"]), ("duplicate", duplicate), ("truncated", truncated)):
            self.counts[name] += hit
        initial = row["role"][:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial, self.seen = initial, key
        self._inserts()
        top: dict[int, tuple] = {}

        def offer(state: int, cost: int, node: Node, edit: str) -> None:
            if self._better(top.get(state), cost, node, edit):
                top[state] = (cost, node, edit)

        for state, (cost, node) in self.best.items():
            offer(state, cost + DELETE, node, "D")
            if not row["blank"] and not duplicate:
                to = BY_INITIAL.get(initial, {}).get(state)
                if to is not None:
                    offer(to, cost + truncated, node, "K")
                offer(TURN[state], cost + truncated + REROLE, node, "R")
        for (strong, weak), more in BRIDGE.items():
            if strong in top and weak in top and top[strong][0] + more < top[weak][0]:
                del top[weak]
        bare = {"turn": row["turn"]}
        self._hold({state: (cost, Node(node, edit, bare if edit == "D" else row)) for state, (cost, node, edit) in top.items()})

    def end(self) -> int:
        """Decides the rest; the cost."""
        self._inserts()
        ends = [self.best[s] for s in (NONE, A) if s in self.best]
        last = ends[0]
        if len(ends) == 2 and (ends[1][0] < last[0] or ends[1][0] == last[0] and parted(ends[1][1], last[1])):
            last = ends[1]
        self._hold({A: last})
        return last[0]


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, blank, truncated, and later: whether an earlier turn has the same role and text. First turns
    are found by an aggregation of digests, so repeated rows meet as one row of each task."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    t = only(turns, conv_id="conv_id", turn="turn", role=text("role"), text=text("text"))
    bare = F.rtrim("text", F.lit(SPACE))
    t = t.withColumns({"blank": bare == "", "truncated": ~F.right(bare, F.lit(1)).isin(ENDS), "at": F.struct(F.col("turn").isNotNull().alias("given"), "turn"),
                       "digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)})
    first = t.groupBy("conv_id", "digest").agg(F.min("at").alias("first_at"))
    first = first.select(F.col("conv_id").alias("conv_f"), F.col("digest").alias("digest_f"), "first_at")
    j = t.join(first, t["conv_id"].eqNullSafe(F.col("conv_f")) & (F.col("digest") == F.col("digest_f")))
    return j.select("conv_id", "turn", "role", "text", "blank", "truncated", (F.col("at") != F.col("first_at")).alias("later"))


def _walked(turns: DataFrame, summary: bool) -> DataFrame:
    kind = turns.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    rows = with_faults(turns).repartition("conv_id").sortWithinPartitions(*order)
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"] if summary else ["conv_id", "step", "edit", "turn", "role", "text"]
    turn_kind = turns.schema["turn"].dataType.simpleString()
    schema = (f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string" if summary
              else f"conv_id {kind}, step long, edit string, turn {turn_kind}, role string, text string")
    types = to_arrow_schema(StructType.fromDDL(schema)).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        walk, conv, audit, digest, n_turns = None, None, bytearray(), None, 0

        def emit(edit: str, row: dict | None, role: str | None, text: str | None) -> None:
            nonlocal n_turns
            audit.extend(edit.encode())
            if not summary:
                out.append((conv, len(audit), edit, row["turn"] if row else None, role, text))
            elif role is not None:
                digest.update((("\n" if n_turns else "") + f"{role}:{text}").encode())
                n_turns += 1

        def close() -> None:
            cost = walk.end()
            if summary:
                out.append((conv, *walk.counts.values(), cost, audit.decode(), digest.hexdigest()))

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return b

        for b in batches:
            for row in b.to_pylist():
                if walk is None or row["conv_id"] != conv:
                    if walk is not None:
                        close()
                    conv, audit, digest, n_turns = row["conv_id"], bytearray(), hashlib.sha256(), 0
                    walk = Walk(emit)
                walk.add(row)
                if len(out) >= 10000:
                    yield flush()
        if walk is not None:
            close()
        if out:
            yield flush()

    return rows.mapInArrow(run, schema)


def edits(turns: DataFrame) -> DataFrame:
    """conv_id, step (from 1), edit (K, R, D or I), turn (of the row edited), role and text as repaired (null where deleted)."""
    return _walked(turns, False)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, step, role, text; steps ascend without being dense."""
    return edits(turns).filter("role is not null").select("conv_id", "step", "role", "text")


def summaries(turns: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, cost, audit, and the digest of the repaired role:text lines, hashed as edits are decided."""
    return _walked(turns, True)


def gaps(turns: DataFrame) -> DataFrame:
    """conv_id, gaps: turn numbers between the smallest and the largest that no row has."""
    t = only(turns, conv_id="conv_id", turn="turn").distinct()
    return t.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))


def damaged(turns: DataFrame) -> DataFrame:
    """Planted faults by crc32 of conv_id:turn: rows dropped, emptied, without end marks, repeated, or spoken by the user. Nulls become one space, except in
    the two ids."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    t = only(turns, conv_id="conv_id", turn="turn", role=text("role"), text=text("text"), fault=F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20)

    def case(n: int, then: Column, other: str) -> Column:
        return F.when(F.col("fault") == n, then).otherwise(F.col(other))
    t = t.filter("fault <> 0").select(
        "conv_id", "turn", case(4, F.lit("user"), "role").alias("role"),
        F.when(F.col("fault") == 1, "").otherwise(case(2, F.regexp_replace("text", "[.!?]", ""), "text")).alias("text"), "fault")
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return t.withColumn("copy", copies).select("conv_id", "turn", "role", "text")
