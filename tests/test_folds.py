"""Folds, passages, spans, medians and text lookups against plain loops."""

import datetime as dt
import random
import statistics

import pytest

from barloom.functions.scale import exact_median
from barloom.operators import concepts, exits, ledger, sectors, trades

D0 = dt.date(2026, 1, 1)
TX = "account string, symbol string, name string, side string, trade_date date, trade_time string, entered_at string, txn_id string, price double, qty long, amount double, fee double"


def day(i):
    return D0 + dt.timedelta(days=i)


def hot_ledger(seed=11, n=900):
    """One holder with most rows, several cycles a day and over months."""
    rng, bal, out = random.Random(seed), {}, []
    for i in range(n):
        key = ("A", rng.choice(["600001"] * 6 + ["600002"]))
        have = bal.get(key, 0)
        buy = have == 0 or rng.random() < 0.45
        qty = rng.randint(1, 9) * 100 if buy else (have if rng.random() < 0.5 else rng.randint(1, have // 100) * 100)
        bal[key] = have + (qty if buy else -qty)
        price = round(rng.uniform(5, 20), 2)
        out.append((*key, rng.choice(["", f"n{i % 7}"]), "买入" if buy else "卖出", day(i // 9), "15:00:00", f"{i:06d}", f"t{i}", price, qty, round(price * qty, 2), 1.5))
    return out


@pytest.mark.parametrize("block,span", [(2, "day"), (4096, "month")])
def test_cycles_match_loop(spark, block, span):
    rows = hot_ledger()
    want, state = {}, {}
    for a, sym, name, side, d, *_, q, amt, fee in rows:
        key = (a, sym)
        bal, n = state.get(key, (0, 0))
        if side == "买入":
            n += bal == 0
            bal += q
        else:
            bal -= q
        state[key] = (bal, n)
        c = want.setdefault((*key, n), {"buy": 0, "sell": 0, "cost": 0.0, "net": 0.0, "first": d, "name": ""})
        c["buy" if side == "买入" else "sell"] += q
        c["cost" if side == "买入" else "net"] += amt + fee if side == "买入" else amt - fee
        c["name"] = name or c["name"]
    got = {(r.account, r.symbol, r.cycle): r for r in ledger.cycles(ledger.fold(spark.createDataFrame(rows, TX), block, span)).collect()}
    assert got.keys() == want.keys()
    for k, c in want.items():
        r = got[k]
        assert (r.buy_qty, r.sell_qty, r.buy_date, r.name) == (c["buy"], c["sell"], c["first"], c["name"])
        assert r.buy_cost == pytest.approx(c["cost"], abs=0.01) and r.sell_net == pytest.approx(c["net"], abs=0.01)


def test_oversold_holder_has_a_position(spark):
    """A balance that rises to nothing from below is no division by zero."""
    rows = [("A", "600001", "", "卖出", day(0), "15:00:00", "1", "a", 1.0, 100, 100.0, 0.0), ("A", "600001", "", "买入", day(1), "15:00:00", "2", "b", 1.0, 100, 100.0, 0.0)]
    r = ledger.positions(spark.createDataFrame(rows, TX)).first()
    assert (r.qty, r.status, r.avg_cost) == (0, "已清仓", 0.0)


def test_after_close_matches_loop(spark):
    rng = random.Random(3)
    closes = {s: [round(10 * (1 + 0.02 * rng.gauss(0, 1)) ** (i % 17) + i * 0.01, 2) for i in range(n)] for s, n in (("600001", 300), ("600002", 70), ("600003", 6))}
    bars = [(s, day(i * 2), c) for s, cs in closes.items() for i, c in enumerate(cs)]
    pos = [(f"A{k}", s, 100, round(rng.uniform(8, 14), 2), rng.choice([None, day(rng.randint(0, 2 * len(closes[s]) + 4))])) for k in range(60) for s in closes]
    stops = [(s, 9.0) for s in closes if s != "600002"]
    got = exits.exit_after_close(spark.createDataFrame(pos, "account string, symbol string, qty long, avg_cost double, start_date date"),
                                 spark.createDataFrame(bars, "symbol string, trade_date date, close double"), spark.createDataFrame(stops, "symbol string, stop double"))
    got = {(r.account, r.symbol): r for r in got.collect()}
    raised = 0
    for a, s, _, cost, start in pos:
        own = [(d, c) for x, d, c in bars if x == s and (start is None or d >= start)]
        r = got[a, s]
        if not own or s == "600002":
            assert r.action == "DATA_ERROR" and r.stop is None
            continue
        best, high = None, 0.0
        for t in range(len(own)):
            high = max(high, own[t][1])
            ten = [c for _, c in own[max(0, t - 9):t + 1]]
            if high / cost - 1 >= 0.05 and len(ten) >= 5:
                best = max(best or 0.0, sum(ten) / len(ten))
        stop = max(9.0, best or 0.0)
        raised += best is not None and stop > 9.0
        assert (r.data_date, r.latest_close, r.high_close) == (own[-1][0], own[-1][1], pytest.approx(high)) and r.stop == pytest.approx(round(stop, 4), abs=1e-4)
        gain, last = high / cost - 1, own[-1][1]
        assert r.action == ("EXIT_NEXT_SESSION" if last < stop else "REDUCE_NEXT_SESSION" if gain >= 0.08 and last <= high * 0.95 else "HOLD")
    assert raised > 20


def test_span_extremes(spark):
    rng = random.Random(5)
    hs = [(s, i + 1, rng.random(), rng.random()) for s, n in (("a", 40), ("b", 3)) for i in range(n)]
    ctx = spark.createDataFrame(hs, "symbol string, rn int, high double, low double")
    rows = trades.span_extremes(ctx, 20).collect()
    assert len(rows[0].highs) == 5
    for r in rows:
        for k in range(5):
            own = [x for x in hs if x[0] == r.symbol and r.rn <= x[1] < r.rn + 2 ** k]
            assert (r.highs[k], r.lows[k]) == (max(x[2] for x in own), min(x[3] for x in own))


def test_median_of_heavy_tail(spark):
    """Half of all values in a sliver of the range, one value shared by many rows, both counts of rows, and a null key."""
    rng = random.Random(9)
    values = {"tail": [rng.random() for _ in range(2001)] + [1e12 * rng.random() for _ in range(2000)], "tied": [7.0] * 3000 + [rng.random() for _ in range(2500)],
              None: [rng.gauss(0, 1) for _ in range(1500)], "one": [3.5], "even": [-1.0, 4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("none", None)], "k string, v double")
    got = {r.k: r.median for r in exact_median(df, ["k"], "v", buckets=16, small=20).collect()}
    assert got == {k: pytest.approx(statistics.median(vs), abs=0) for k, vs in values.items()}


def test_contained_names(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ab概") for _ in range(rng.randint(1, 6)))
    needles, names = {word() for _ in range(60)}, {word() for _ in range(60)}
    got = concepts.contained(spark.createDataFrame([(w,) for w in needles], "x string"), spark.createDataFrame([(w,) for w in names], "y string"))
    assert {tuple(r) for r in got.collect()} == {(n, h) for n in needles for h in names if n in h}
    assert got.count() == len(got.collect())


def test_concept_names_with_any_white_space(spark):
    df = spark.createDataFrame([("光　通信 概念",), ("甲|乙",), ("半导体　液冷及农业",)], "c string")
    got = [list(r[0]) for r in df.select(concepts.concept_terms("c")).collect()]
    assert got[0] == ["光通信", "光", "通信"] and got[1] == ["甲|乙"]
    assert got[2] == ["半导体液冷及农业", "半导体", "液冷", "农业"]


def test_mentions(spark):
    texts = ["abcabcabc xyz", "光通信走强", None, "", "ab"]
    boards = ["abcx", "cab", "xyz", "光通信", "光", "通讯", "zz", "a", "abcabcabcabc"]
    got = concepts.mentioned_boards(spark.createDataFrame([(b,) for b in boards], "board string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {r.board for r in got.collect()} == {b for b in boards if any(b in (t or "") for t in texts)}
    none = spark.createDataFrame([], "board string")
    assert concepts.mentioned_boards(none, spark.createDataFrame([("x",)], "text string")).count() == 0


def test_coverage_by_source_and_baseline(spark):
    m = spark.createDataFrame([("1", "行业", "b", "s"), ("2", "行业", "b", "s"), ("1", "概念", "c", "s"), ("9", "概念", "c", "t"), ("2", "概念", "c", None)], "symbol string, board_type string, board string, source string")
    master = spark.createDataFrame([("1",), ("2",)], "symbol string")
    assert {(r.board_type, r.source, r.symbols, r.coverage) for r in sectors.source_coverage(m, master).collect()} == {("行业", "s", 2, 1.0), ("概念", "s", 1, 0.5), ("概念", "t", 1, 0.5)}
    assert sectors.baseline_usable(m, master).first().usable is True
    assert sectors.baseline_usable(m.filter("symbol = '1'"), master).first().usable is False
    assert sectors.baseline_usable(m, master.limit(0)).first().usable is False
    assert sectors.coverage(m.limit(0), master).first().state == "PROVISIONAL"
