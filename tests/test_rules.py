"""Hand-made cases and row-loop models."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from barloom.functions import scalars as s
from barloom.functions.scale import exact_median, running_sums, top_k
from barloom.operators import concepts, evidence, exits, feedback, history, identity, ledger, opinions, screen
from barloom.operators.features import features

D0 = dt.date(2026, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def bars_of(spark, symbol, closes, vols=None, highs=None, lows=None, raw=None):
    rows = [(symbol, D0 + dt.timedelta(days=i), float(c), float(highs[i] if highs else c * 1.01), float(lows[i] if lows else c * 0.99),
             float(vols[i]) if vols else 100.0, 1.0, float(raw[i] if raw else c)) for i, c in enumerate(closes)]
    return frame(spark, rows, "symbol string, trade_date date, close double, high double, low double, volume double, turnover double, raw_close double")


def newest(df):
    return df.orderBy(F.col("trade_date").desc()).first()


# ---- scalars ---------------------------------------------------------------------------------------------
def test_codes_and_names(spark):
    x = frame(spark, [("sh600801",), ("801.0",), ("abc",), (None,), ("1234567",)], "c string")
    assert [r[0] for r in x.select(s.norm_code("c")).collect()] == ["600801", "000801", "", "", "234567"]
    n = frame(spark, [("Ａ Ｂc",)], "n string").select(s.name_key("n")).first()[0]
    assert n == "ABC"
    st = frame(spark, [("*ST甲",), ("S*ST乙",), ("平安ST",), ("sst丙",)], "n string").select(s.is_st("n")).collect()
    assert [r[0] for r in st] == [True, True, False, True]
    lim = frame(spark, [("600000", "x"), ("300001", "x"), ("689001", "x"), ("920001", "x"), ("600000", "平安 S T")], "c string, n string")
    assert [r[0] for r in lim.select(s.limit_pct("c", "n")).collect()] == [10.0, 20.0, 20.0, 30.0, 5.0]


@pytest.mark.parametrize("symbol,prev,close,hit", [("600001", 10.0, 11.0, True), ("300001", 10.0, 12.0, True), ("688001", 10.0, 12.0, True),
                                                   ("920001", 10.0, 13.0, True), ("600001", 3.33, 3.66, True), ("600001", 10.0, 10.99, False)])
def test_limit_price_rounding(spark, symbol, prev, close, hit):
    b = bars_of(spark, symbol, [prev] * 25 + [close])
    r = newest(evidence.limit_up_evidence(b))
    assert r.limit_up_25 is hit and r.limit_verified_days == 25


# ---- breakout evidence against a loop ---------------------------------------------------------------------
def loop_stage(rows):
    """Row-loop model of the evidence rules over (close, high, low, volume) tuples; independent of the Spark form."""
    n = len(rows)
    if n < 10:
        return "INELIGIBLE", "", 0
    c, h, lo, v = zip(*rows)

    def platform(end):
        best = None
        for d in (3, 4, 5):
            a = end - d
            if a < 0:
                continue
            top, bot, mv = max(h[a:end]), min(lo[a:end]), sum(v[a:end]) / d
            before = v[max(0, a - d):a]
            if (top - bot) / bot <= 0.10 and (not before or mv <= sum(before) / len(before) * 1.05):
                best = (d, sorted(h[a:end])[-2], mv)
        return best
    last = c[-10:]
    pk = last.index(max(last[:7]))
    tail = last[pk + 1:]
    tr = min(tail)
    ti = pk + 1 + tail.index(tr)
    n_shape = ti < 9 and tr / last[pk] - 1 <= -0.08 and last[-1] / tr - 1 >= 0.05
    ev = None
    for i in range(max(5, n - 5), n):
        p = platform(i)
        if p and c[i - 1] <= p[1] < c[i] and v[i] / p[2] >= 1.2:
            ev = (i, p)
    if ev is None:
        p = platform(n)
        return ("READY_FOR_BREAKOUT" if p and not n_shape else "INELIGIBLE"), "", p[0] if p else 0
    i, (d, up, _) = ev
    k = n - 1 - i
    route = ""
    if k and not n_shape and min(lo[i + 1:]) >= up * 0.98:
        ratio = sum(v[i + 1:]) / k / v[i]
        renew = c[-1] >= up and 0 < c[-1] / c[-2] - 1 <= 0.03
        if k <= 3 and ratio <= 0.8 and renew:
            route = "RETEST_RENEWED_STRENGTH"
        top, bot = max(h[i + 1:]), min(lo[i + 1:])
        if 2 <= k and ratio <= 0.8 and renew and min(c[i + 1:]) >= up and lo[-1] >= lo[i + 1] * 0.98 and (top - bot) / bot <= 0.06 and c[-1] / up - 1 <= 0.05:
            route = "ABOVE_PLATFORM_TIGHT_HOLD"
        if k >= 3:
            mh, ml, mv = max(h[i + 1:-1]), min(lo[i + 1:-1]), sum(v[i + 1:-1]) / (k - 1)
            if (mh - ml) / ml <= 0.05 and mv <= v[i] * 0.8 and ml >= up * 0.98 and c[-1] > mh and 1.05 <= v[-1] / mv <= 1.8 and c[-1] / mh - 1 <= 0.03:
                route = "MICRO_PLATFORM_REBREAK"
    stage = "EFFECTIVE_BREAKOUT_CONFIRMED" if route else "BREAKOUT_AWAIT_RETEST" if k == 0 else "RETEST_STABILIZING"
    return stage, route, d


def test_breakout_stage_matches_loop(spark):
    rng = random.Random(7)
    data, want = [], {}
    for sym in range(12):
        price, rows = 10.0, []
        for i in range(60):
            price = round(price * (1 + rng.choice([0.001, -0.002, 0.004, 0.012, -0.01, 0.025, -0.03, 0.0])), 2)
            hi, lo = round(price * (1 + rng.random() * 0.012), 2), round(price * (1 - rng.random() * 0.012), 2)
            vol = float(rng.choice([60, 70, 80, 100, 130, 220]))
            rows.append((price, hi, lo, vol))
            data.append((f"{600000 + sym}", D0 + dt.timedelta(days=i), price, hi, lo, vol))
            want[(f"{600000 + sym}", D0 + dt.timedelta(days=i))] = loop_stage(rows)
    b = frame(spark, data, "symbol string, trade_date date, close double, high double, low double, volume double")
    got = {(r.symbol, r.trade_date): (r.breakout_stage, r.breakout_route, r.platform_days) for r in evidence.breakout_evidence(b).collect()}
    assert got == want
    assert len({x[1] for x in want.values()}) >= 3 and len({x[0] for x in want.values()}) == 5


def test_features_null_rules(spark):
    b = bars_of(spark, "600001", [10 + i * 0.1 for i in range(40)])
    b = b.withColumn("close", F.when(F.dayofmonth("trade_date") == 20, None).otherwise(F.col("close")))
    rows = {r.trade_date: r for r in features(b, 250).collect()}
    after = rows[dt.date(2026, 1, 22)]
    assert after.ma5 is None and after.vol5 is not None and after.ret1 is not None
    assert rows[dt.date(2026, 1, 25)].ma5 is not None
    assert rows[D0].ret1 is None and rows[D0].amp5 is None


# ---- screening -------------------------------------------------------------------------------------------
def test_soft_capacity_extends_ties_and_clips(spark):
    rows = [(D0, f"{i:06d}", sc, i != 3) for i, sc in enumerate([9, 8, 8, 8, 8, 7, 8, 5])]
    x = frame(spark, rows, "trade_date date, symbol string, sc int, ok boolean")

    def picked(lo, hi):
        z = screen.rank_and_audit(x, "sc", lo, hi, "ok", "t")
        return sorted(r.symbol for r in z.filter("selected").collect())
    assert picked(2, 10) == ["000000", "000001", "000002", "000004", "000006"]
    assert picked(2, 3) == ["000000", "000001", "000002"]
    assert picked(50, 60) == [f"{i:06d}" for i in range(8) if i != 3]
    assert picked(None, None) == [f"{i:06d}" for i in range(8) if i != 3]
    z = {r.symbol: r.stage_rank for r in screen.rank_and_audit(x, "sc", eligible="ok").collect()}
    assert z["000003"] == 2 and z["000005"] == 7     # ineligible rows are ranked as well


def test_percentile_average_ties(spark):
    x = frame(spark, [(D0, str(i), v) for i, v in enumerate([1.0, 2.0, 2.0, None, 5.0])], "trade_date date, symbol string, v double")
    got = {r.symbol: r.p for r in screen.pct_rank_average(x, "v", "p").collect()}
    assert got == {"0": 0.25, "1": 0.625, "2": 0.625, "3": None, "4": 1.0}


# ---- ledger ----------------------------------------------------------------------------------------------
TX = "account string, symbol string, name string, side string, trade_date date, trade_time string, entered_at string, txn_id string, price double, qty long, amount double, fee double"


def random_ledger(seed, n=400):
    rng, bal, out = random.Random(seed), {}, []
    for i in range(n):
        key = ("A", rng.choice(["600001"] * 5 + ["600002", "300003"]))   # one symbol holds most rows
        day = D0 + dt.timedelta(days=i // 40)
        have = bal.get(key, 0)
        buy = have == 0 or rng.random() < 0.5
        qty = rng.randint(1, 9) * 100 if buy else (have if rng.random() < 0.2 else rng.randint(1, have // 100) * 100)
        bal[key] = have + (qty if buy else -qty)
        price = round(rng.uniform(5, 20), 2)
        out.append((*key, "n", "买入" if buy else "卖出", day, "15:00:00", f"{i:06d}", f"t{i}", price, qty, round(price * qty, 2), 1.5))
    return out


def test_positions_and_lots_match_loop(spark):
    rows, day = random_ledger(3), D0 + dt.timedelta(days=9)
    st, free = {}, {}
    for a, sym, _, side, d, _, _, _, _, q, amt, fee in rows:
        x = st.setdefault((a, sym), [0, 0.0, 0.0])
        if side == "买入":
            x[1] = (x[0] * x[1] + amt + fee) / (x[0] + q)
            x[0] += q
            if d < day:
                free[(a, sym)] = free.get((a, sym), 0) + q
        else:
            x[2] += amt - fee - x[1] * q
            x[0] -= q
            x[1] = 0.0 if x[0] == 0 else x[1]
            free[(a, sym)] = max(0, free.get((a, sym), 0) - q)
    t = frame(spark, rows, TX)
    for block in (3, 4096):
        got = {(r.account, r.symbol): r for r in ledger.positions(t, block).collect()}
        for k, (q, avg, pnl) in st.items():
            assert got[k].qty == q and got[k].avg_cost == pytest.approx(avg, abs=1e-3) and got[k].realised_pnl == pytest.approx(pnl, abs=0.02)
    lots = {(r.account, r.symbol): r.sellable for r in ledger.active_lots(t, str(day)).collect()}
    assert lots == {k: min(q, free.get(k, 0)) for k, (q, _, _) in st.items() if q > 0}


def test_oversell_is_reported(spark):
    a = frame(spark, [("A", "600001", "", "买入", D0, "15:00:00", "1", "a", 1.0, 100, 100.0, 0.0)], TX)
    b = frame(spark, [("A", "600001", "", "卖出", D0, "15:00:00", "2", "b", 1.0, 200, 200.0, 0.0)], TX)
    led, bad = ledger.append_transactions(a, b)
    assert led.count() == 2 and [r.txn_id for r in bad.collect()] == ["b"]


def test_normalise_rejects_with_reason(spark):
    x = frame(spark, [("2026-01-01", "B", "600001", "10", "100", "1000"), ("2026-01-01", "B", "600001", "10", "100", "1001"),
                      ("2026-01-01", "X", "600001", "10", "100", ""), ("bad", "B", "600001", "10", "100", ""),
                      ("2026-01-01", "S", "600001", "0", "100", ""), ("2026-01-01", "S", "600001", "1", "1.5", "")],
              "`日期` string, `方向` string, `代码` string, `价格` string, `数量` string, `金额` string")
    ok, bad = ledger.normalise_transactions(x)
    r = ok.collect()
    assert len(r) == 1 and r[0].account == "默认账户" and r[0].trade_time == "15:00:00" and len(r[0].txn_id) == 24
    assert sorted(b.reject_reason for b in bad.collect()) == sorted(["成交金额与价格×数量不一致", "操作必须是买入或卖出", "交易日期无效",
                                                                     "成交价格必须大于0", "成交数量必须是正整数"])


# ---- exits -----------------------------------------------------------------------------------------------
def exit_case(spark, price, closes2, sellable=2100, cost=10.0, hist=None, stop=9.5):
    pos = frame(spark, [("A", "600001", 2100, sellable, cost, D0)], "account string, symbol string, qty long, sellable long, avg_cost double, start_date date")
    b = bars_of(spark, "600001", hist or [10.0] * 11)
    m = frame(spark, [("600001", i, float(c)) for i, c in enumerate(closes2)], "symbol string, ts int, close double")
    sn = frame(spark, [("600001", price)], "symbol string, price double")
    return exits.exit_intraday(pos, sn, m, b, frame(spark, [("600001", stop)], "symbol string, stop double")).first()


def test_exit_priorities(spark):
    r = exit_case(spark, 9.3, [9.4, 9.3])
    assert (r.action, r.action_qty) == ("EXIT_ALL", 2100)
    r = exit_case(spark, 10.4, [10.5, 10.4], hist=[10.0] * 10 + [11.2])
    assert (r.action, r.action_qty) == ("REDUCE_50", 1000)
    assert exit_case(spark, 9.3, [9.4, 9.3], sellable=0).action == "HOLD_T1"
    assert exit_case(spark, 9.3, [9.3]).action == "DATA_ERROR"
    assert exit_case(spark, 9.3, [9.6, 9.3]).action == "HOLD"


# ---- feedback --------------------------------------------------------------------------------------------
def test_horizons_exclude_day_zero_and_first_touch(spark):
    closes = [100, 100.5, 99, 101, 102, 103, 104, 105, 106, 110, 120]
    lows = [80, 99, 94, 100, 100, 100, 100, 100, 100, 100, 100]
    b = bars_of(spark, "600001", closes, lows=lows)
    rec = frame(spark, [("r", "600001", D0, 95.0), ("s", "600001", D0 + dt.timedelta(days=9), 95.0), ("t", "999999", D0, 1.0)],
                "reco_id string, symbol string, reco_date date, stop double")
    g = {r.reco_id: r for r in feedback.evaluate(rec, b).collect()}
    assert g["r"].ret_d3_pct == 1.0 and g["r"].ret_d10_pct == 20.0 and g["r"].stop_touch_3 is True
    assert g["r"].first_touch_date == D0 + dt.timedelta(days=2) and g["r"].data_status == "D+10完成"
    assert g["s"].stop_touch_3 is None and g["s"].data_status == "跟踪中" and g["t"].data_status == "行情缺失"


# ---- scale helpers ---------------------------------------------------------------------------------------
def test_exact_median_and_running_sums_with_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}", D0 + dt.timedelta(days=rng.randint(0, 9)), i, rng.choice([1.0, 2.0, 2.0, 7.5, rng.random() * 100]))
            for i in range(3000)]
    x = frame(spark, rows, "k string, d date, i int, v double")
    want = {}
    for k, _, _, v in rows:
        want.setdefault(k, []).append(v)
    got = {r.k: r.median for r in exact_median(x, ["k"], "v", buckets=16).collect()}
    assert got == {k: pytest.approx(statistics.median(v)) for k, v in want.items()}
    run, acc = {}, {}
    for k, d, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        acc[k] = acc.get(k, 0.0) + v
        run[i] = acc[k]
    res = {r.i: r.t for r in running_sums(x, ["k"], "d", ["i"], {"t": F.col("v")}).collect()}
    assert all(res[i] == pytest.approx(run[i]) for i in run)
    top = {(r.k, r.rn): r.i for r in top_k(x, ["k"], [F.col("v").desc(), F.col("i")], 3, ["i"]).collect()}
    best = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[3], r[2]))[:3]
    assert [top[("hot", j + 1)] for j in range(3)] == [r[2] for r in best]


# ---- identity, history, concepts, opinions ------------------------------------------------------------------
def test_registry_merge_and_quirk(spark):
    reg = frame(spark, [("600001", "甲", D0, D0, 1, "已淘汰", D0, "x"), ("600002", "*ST乙", D0, D0, 1, "活跃", None, "")],
                "symbol string, name string, first_submit date, last_submit date, submit_count int, status string, eliminated_on date, eliminated_reason string")
    daily = frame(spark, [("600001", "甲"), ("600003", "ST丙"), ("600004", "丁"), ("399001", "深证成指")], "symbol string, name string")
    out, ch = identity.merge_registry(reg, daily, "2026-02-01")
    st = {r.symbol: (r.status, r.submit_count) for r in out.collect()}
    assert st == {"600001": ("活跃", 2), "600002": ("已淘汰", 1), "600004": ("活跃", 1)}
    assert {r.symbol: r.change for r in ch.collect()} == {"600001": "重新激活", "600003": "ST股票硬排除", "600004": "新增", "399001": "隔离为指数/非个股"}
    weak = frame(spark, [("600001", -1.0, -1.0, -1.0, -1.0, -1.0, -1.0)], "symbol string, ret10 double, ret20 double, ret40 double, ret120 double, ma20_dist double, ma30_slope5 double")
    again = identity.maintain_registry(reg, weak, "2026-06-01")[0].filter("symbol = '600001'").first()
    kept = identity.maintain_registry(reg, weak, "2026-06-01", strict_quirk=False)[0].filter("symbol = '600001'").first()
    assert again.eliminated_on == dt.date(2026, 6, 1) and kept.eliminated_on == D0


def test_append_closed_day_guard(spark):
    h = bars_of(spark, "600001", [10.0] * 5).unionByName(bars_of(spark, "600002", [10.0] * 5))
    sp = frame(spark, [("600001", 10.2, None, 10.3, 10.0, 10.0, 5.0), ("600002", 9.0, 9.0, 9.0, 9.0, 9.5, 5.0)],
               "symbol string, close double, open double, high double, low double, previous double, volume double")
    out, res = history.append_closed_day(h, sp, h.select("symbol"), "2026-01-06", "2026-01-05")
    assert {r.symbol: r.outcome for r in res.collect()} == {"600001": "appended", "600002": "corporate_action"}
    r = newest(out.filter("symbol = '600001'"))
    assert r.close == 10.2 and r.open == 10.2 and r.adj_factor == 1.0


def test_concept_matching(spark):
    w = frame(spark, [(0, "AI算力（光模块）"), (1, "白酒概念"), (2, "新能源汽车零部件")], "request_order int, name string")
    cat = frame(spark, [("算力概念",), ("白酒",), ("汽车零部件",), ("汽车",)], "concept string")
    got = {r.concept: (r.request_order, r.match) for r in concepts.match_concepts(w, cat).collect()}
    assert got["白酒"] == (1, "exact") and got["算力概念"] == (0, "exact") and got["汽车零部件"] == (2, "substring") and "汽车" not in got


def test_a_name_is_matched_once_however_often_it_is_asked_for(spark):
    w = frame(spark, [(i, ("白酒概念", "新能源汽车零部件")[i % 2]) for i in range(5, 205)] + [(7, None)], "request_order int, name string")
    cat = frame(spark, [("白酒",), ("汽车零部件",)], "concept string")
    got = concepts.match_concepts(w, cat)
    assert {r.concept: (r.request_order, r.wanted, r.match) for r in got.collect()} == {"白酒": (6, "白酒概念", "exact"), "汽车零部件": (5, "新能源汽车零部件", "substring")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Generate posexplode") <= plan.count("Aggregate [name")


def test_opinion_dates(spark):
    t = frame(spark, [("2026年9月11日复盘", True), ("9.10复盘", False), ("明日策略9.4", True), ("0911复盘", True), ("2026.9.11 市场复盘", True)], "t string, ok boolean")
    assert all(r.got == r.ok for r in t.withColumn("got", opinions.title_date_ok("t", "2026-09-11")).collect())
    p = frame(spark, [("发表于 2026-09-11 21:05",), ("26-09-11 21:05",), ("none",)], "t string").select(opinions.published_at("t").alias("p")).collect()
    assert [r.p for r in p] == [dt.datetime(2026, 9, 11, 21, 5)] * 2 + [None]


# ---- cases that the driver's tables do not hold --------------------------------------------------------
def test_business_clock_boundaries(spark):
    from barloom.functions.scalars import business_clock
    from barloom.operators import history, intraday, opinions
    from barloom.streaming.streams import late_data_rule
    rows = [("2024-01-01T16:30:00Z", "00:30"), ("2024-01-01T21:59:00Z", "05:59"), ("2024-01-02T06:45:00Z", "14:45"), ("2024-01-02T07:00:00Z", "15:00"), ("2024-01-02T14:00:00Z", "22:00")]
    x = spark.createDataFrame(rows, "t string, hm string").withColumn("ts", F.to_timestamp("t"))
    assert all(r.a == r.hm for r in x.select("hm", F.date_format(business_clock("ts"), "HH:mm").alias("a")).collect())
    y = x.withColumns({"open": F.lit(True), "prev": F.lit("2023-12-29").cast("date"), "day": F.lit("2024-01-02").cast("date")})
    got = {r.hm: r for r in y.select(
        "hm", intraday.tail_window_ok("ts", "finalize").alias("tail"), history.business_date("ts").alias("bd"),
        history.expected_latest("ts", "open", "prev").cast("string").alias("latest")).collect()}
    assert [h for h, r in got.items() if r.tail] == ["14:45"]
    assert str(got["00:30"].bd) == "2024-01-01" and str(got["05:59"].bd) == "2024-01-01" and str(got["14:45"].bd) == "2024-01-02"
    assert got["14:45"].latest == "2023-12-29" and got["15:00"].latest == "2024-01-02"
    gate = opinions.finalise_gate(y.select(F.col("day").alias("article_day"), F.col("ts").alias("now"), F.lit(20).alias("n_docs"), "hm"))
    assert {r.hm for r in gate.collect() if r.release} == {"22:00"}
    inside, out = late_data_rule(x, "14:32", "14:55")
    assert inside.count() == 1 and out.count() == 4
    feed = spark.createDataFrame([(1, '[{"postTime":"1704126600","topicType":"A","newTopicID":"7","subject":"abcdefgh","viewNum":"1"}]')], "page_no int, items string")
    assert opinions.feed_candidates(feed, "2024-01-02", "u/").count() == 1  # half past midnight there, still the day before by UTC


def test_ingest_keeps_first_rows(spark):
    from barloom.operators.identity import symbol_universe
    from barloom.sources.ingest import read_pool_text, resolve_header
    lines = spark.createDataFrame([("1 甲",), ("12345678 z",), ("12345678 a",), ("none",)], "value string").coalesce(1)
    assert {(r.symbol, r.name) for r in read_pool_text(lines).collect()} == {("000001", "甲"), ("345678", "z")}
    u = symbol_universe(spark.createDataFrame([("000001", "z"), ("000001", "a")], "`股票代码` string, `证券简称` string").coalesce(1))
    assert [tuple(r) for r in u.collect()] == [("000001", "z")]
    assert resolve_header(["x", "Stock_Code", "the code"], ["代码", "stockcode", "code"]) == "Stock_Code" and resolve_header(["x"], ["code"]) is None
    assert resolve_header(["my code", "code b"], ["code"]) == "my code"


def test_best_snapshot_order_and_empty_sources(spark):
    from barloom.operators.market import best_snapshot
    d = [("d1", "b", 1.0), ("d1", "a", 1.0), ("d2", "a", None), ("d2", "a", None), ("d2", "b", 2.0), ("d3", "a", None)]
    x = spark.createDataFrame(d, "trade_date string, source string, pct double")
    assert {(r.trade_date, r.source) for r in best_snapshot(x, ["a", "b"]).collect()} == {("d1", "a"), ("d2", "b")}


def test_sector_strength_ranks_one_figure_per_table(spark):
    from barloom.operators.sectors import sector_strength
    x = spark.createDataFrame([("概念", "now", "a", 5.0, 1.0), ("概念", "now", "b", None, 99.0), ("行业", "now", "b", None, 3.0)],
                              "board_type string, period string, board string, net double, pct double")
    got = {r.board: list(r.evidence) for r in sector_strength(x).collect()}
    assert got == {"a": ["概念_now第1/1（净额=5.00）"], "b": ["行业_now第1/1（涨跌幅=3.00）"]}


def test_stream_ingest_keeps_late_rows_and_drops_repeats(spark, tmp_path):
    from barloom.streaming import streams
    days = [("k1", "2024-03-01"), ("k2", "2024-03-20"), ("k3", "2024-01-01"), ("k1", "2024-03-01"), ("k4", "2024-04-01"), ("k1", "2024-03-01")]
    for i, r in enumerate(days):
        spark.createDataFrame([r], "txn_id string, day string").withColumn("ts", F.to_timestamp("day")).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    src = spark.readStream.schema("txn_id string, day string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b*"))
    assert sorted(r.txn_id for r in spark.read.parquet(streams.stream_ingest(src)).collect()) == ["k1", "k2", "k3", "k4"]
    latest = streams.run_to_table(src.groupBy("txn_id").count(), "counts", "update", ("txn_id",))
    assert {r.txn_id: r["count"] for r in spark.read.parquet(latest).collect()} == {"k1": 3, "k2": 1, "k3": 1, "k4": 1}


def test_mentioned_boards_of_any_length(spark):
    from barloom.operators.concepts import mentioned_boards
    names = ["a", "bc", "long board name " + "x" * 300, "absent", *("n" * i for i in range(3, 300, 7))]
    texts = ["zz " + names[2] + " bc", "only a here"]
    got = mentioned_boards(spark.createDataFrame([(n,) for n in names], "board string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {r.board for r in got.collect()} == {n for n in names if any(n in t for t in texts)}


def test_titles_times_and_texts(spark):
    from barloom.operators.opinions import clean_text, published_at, title_date_ok
    times = [("x 2024年9月4日 8:05 y", "2024-09-04 08:05"), ("2024/9/4T10:00", "2024-09-04 10:00"), ("24-9-4 10:00", "2024-09-04 10:00"), ("2024-13-4 10:00", None),
             ("12024-9-4 10:00", None), ("", None), (None, None), ("24/9/4 10:00", None)]
    got = [r.a for r in spark.createDataFrame(times, "t string, w string").select(F.date_format(published_at("t"), "yyyy-MM-dd HH:mm").alias("a")).collect()]
    assert got == [w for _, w in times]
    titles = [("9.4复盘", True), ("2024年9月4日收盘复盘", True), ("9.3复盘", False), ("0904复盘", True), ("0903复盘", False), ("明日策略9.3", True), ("复盘", True), ("9.3复盘 9.4复盘", True)]
    got = [r.a for r in spark.createDataFrame(titles, "t string, w boolean").select(title_date_ok("t", "2024-09-04").alias("a")).collect()]
    assert got == [w for _, w in titles]
    raw = " a\t　 b \r\n\r\n\n\n c\rd  "
    assert spark.createDataFrame([(raw,), (None,)], "t string").select(clean_text("t").alias("a")).collect()[0].a == "a b \n\n c\nd"


def test_shared_folder_is_needed_off_one_machine(spark, monkeypatch):
    from barloom import session

    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"
            getConf = staticmethod(lambda: Fake.conf)
    with pytest.raises(RuntimeError):
        session.shared_dir(Fake)


def test_articles_with_nested_blocks_and_dates(spark):
    from barloom.operators.opinions import extract_articles
    inner = "段落" * 1425
    page = ("<html><head><title>t</title><meta name=\"date\" content=\"2020-01-01\"><meta content='2024-09-04 18:00' property='article:published_time'></head><body><nav>菜单</nav>"
            f"<h1>9.4 <b>复盘</b></h1><div class='main-content'><p>一</p><div class=\"x\"><div>{inner}</div></div>尾<br>{inner}</div><script>var a='</div>'</script>关于我们</body></html>")
    rows = [("a", page), ("b", page.replace("09-04", "09-03")), ("c", page.replace("<h1>9.4", "<h1>9.3")), ("d", None), ("e", "<p>short")]
    x = spark.createDataFrame(rows, "url string, html string")
    got = {r.url: r for r in extract_articles(x).collect()}
    assert got["a"].body == "\n".join(["一", inner, "尾", inner]) and got["a"].title == "9.4 复盘" and str(got["a"].published_at) == "2024-09-04 18:00:00"
    assert got["d"].body == "" and got["e"].body == "short" and got["e"].published_at is None
    assert {r.url for r in extract_articles(x, day="2024-09-04").collect()} == {"a"}


def test_pool_files_of_all_kinds(spark, tmp_path):
    from barloom.sources.ingest import read_pool_files
    texts = {"a.csv": ("code,证券简称\n000001,平安\n000001,again\nbad,x\n", "gb18030"), "b.txt": ("股票代码\t股票名称\n600000.0\t浦发\n", "utf-8-sig"),
             "c.csv": ("名称;x\n万 科Ａ;1\n无此名;2\n", "utf-8"), "d.csv": ("Stock_Code|stockname\n300001|特锐德\n", "utf-16")}
    for n, (t, enc) in texts.items():
        (tmp_path / n).write_bytes(t.encode(enc))
    names = spark.createDataFrame([("000002", "万科A"), ("1", "two"), ("2", "two")], "symbol string, name string")
    got = {r.symbol: r.name for r in read_pool_files(spark, [str(tmp_path)], names).collect()}
    assert got == {"000001": "平安", "600000": "浦发", "000002": "万 科Ａ", "300001": "特锐德"}


def test_coverage_gate_stops_the_job(spark):
    from barloom.sources.ingest import assert_coverage
    rows = [("成功",)] * 8 + [("失败",)] * 2
    audit = spark.createDataFrame(rows, "status string")
    assert_coverage(audit, floor=5)
    with pytest.raises(RuntimeError):
        assert_coverage(audit, share=0.9, floor=5)


def test_missing_history_stops_the_replay(spark, tmp_path):
    import check_oracle as co

    from barloom.plans import load_catalog
    sf = "/root/testdata/sf0.001"
    for t in set(co.TABLES) - {"supplier"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    one_more = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("s_suppkey", F.explode(F.array("s_suppkey", F.lit(501))))
    one_more.write.parquet(f"{tmp_path}/supplier.parquet")
    with pytest.raises(RuntimeError, match="1 active symbols have no bar, the first is 300501"):
        load_catalog().QUERIES["revision_replay"](spark, str(tmp_path))


def test_history_is_asserted_before_any_stage(spark, monkeypatch):
    from barloom.plans import funnel
    b = bars_of(spark, "600001", [10.0] * 3)
    gone = frame(spark, [("600001",), ("600003",), ("600002",), ("600003",), (None,)], "symbol string")
    assert sorted((r.symbol for r in funnel.without_history(b, gone).collect()), key=str) == ["600002", "600003", "600003", None]
    funnel.assert_history(b, frame(spark, [("600001",), ("600001",), (None,)], "symbol string"))
    monkeypatch.setattr(funnel, "funnel", None)
    with pytest.raises(RuntimeError, match="2 active symbols have no bar, the first is 600002"):
        funnel.revision_replay(b, gone)


def test_active_symbols_need_no_fold(spark, monkeypatch):
    import check_oracle as co

    from barloom.plans import load_catalog
    cat, sf = load_catalog(), "/root/testdata/sf0.001"
    monkeypatch.setattr(ledger, "fold", None)
    assert co.compare(spark, co.connect(sf), sf, "active_symbols", cat.QUERIES["active_symbols"], cat.ORACLE["active_symbols"]).startswith("ok")
