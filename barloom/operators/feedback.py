"""Recommendation registry and its scoring over fixed horizons and by executed trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import first_match, flag, to_double
from barloom.functions.scale import attach, exact_median, last_at_or_before, newest_row
from barloom.operators.ledger import CLOSED, OPEN, trade_cycles
from barloom.operators.panel import by_symbol, spread
from barloom.session import materialise

# Data states and result labels.
NO_BARS, WAIT_CLOSE, NO_CLOSE, DONE, TRACKING = "行情缺失", "等待推荐日正式收盘", "推荐日收盘缺失", "D+10完成", "跟踪中"
ANCHOR_KEPT = "跟踪中（收盘锚点已保存，等待后续行情）"
SOLD, HELD = "实盘已卖出", "实盘持仓中"
WIN, LOSS, FLAT = "盈利卖出", "亏损卖出", "平本卖出"
HORIZONS = (3, 5, 10)


def register(old: DataFrame, decisions: DataFrame, snapshot: DataFrame, profile: DataFrame, trade_date: str) -> DataFrame:
    """TRADE decisions become recommendations keyed date_code; the last row per id wins."""
    prices = [c for c in ("price", "last_price", "current", "value", "close_price", "close") if c in snapshot.columns]
    snap = snapshot.select("symbol", F.coalesce(*[to_double(c) for c in prices]).alias("reference_price"))
    x = decisions.filter(flag(F.col("selected")) & (F.upper("decision") == "TRADE"))
    x = x.select("symbol", "stop").join(snap, "symbol", "left").join(
        profile.select("symbol", F.col("primary_board"), F.array_join("concepts", "；").alias("concepts")), "symbol", "left")
    day = F.lit(trade_date)
    x = x.select(F.concat_ws("_", day, "symbol").alias("reco_id"), "symbol", day.cast("date").alias("reco_date"), "stop",
                 "reference_price", F.coalesce("primary_board", F.lit("")).alias("primary_board"),
                 F.coalesce("concepts", F.lit("")).alias("concepts"), F.lit(WAIT_CLOSE).alias("data_status"))
    u = old.withColumn("_v", F.lit(0)).unionByName(x.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return newest_row(u, ["reco_id"], [F.col("_v")]).drop("_v")


def recover_reference(recos: DataFrame, snaps: DataFrame) -> DataFrame:
    """Fill a missing reference price from that day's newest stored snapshot (symbol, trade_date, captured_at, price)."""
    s = (snaps.filter(F.col("price").isNotNull()).groupBy("symbol", F.col("trade_date").alias("reco_date"))
         .agg(F.max_by("price", "captured_at").alias("_p")))
    return (recos.join(s, ["symbol", "reco_date"], "left")
            .withColumn("reference_price", F.coalesce("reference_price", "_p")).drop("_p"))


def _set_aside(recos: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """recos with the columns that a step is about to compute under other names, so that a registry can go through the step again."""
    return recos.withColumnsRenamed({c: f"_old_{c}" for c in names if c in recos.columns})


def _merged(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """New values where there are any, else what the registry held."""
    held = [c for c in names if f"_old_{c}" in df.columns]
    return df.withColumns({c: F.coalesce(c, f"_old_{c}") for c in held}).drop(*[f"_old_{c}" for c in held])


SCORES = (*(f"d{h}_{x}" for h in HORIZONS for x in ("date", "close")), *(f"ret_d{h}_pct" for h in HORIZONS), "stop_touch_3", "stop_touch_5", "first_touch_date")
OUTCOMES = ("trade_status", "actual_return_pct", "actual_result", "actual_buy_date", "actual_sell_date", "n_cycles", "exit_tracking_date")


def evaluate(recos: DataFrame, bars: DataFrame, asof: str | None = None) -> DataFrame:
    """Closes 3, 5 and 10 bars on and stop touches: one window over bars, one equi join. Scores that bars no longer give stay as they were."""
    recos = _set_aside(recos, SCORES)
    b = bars if asof is None else bars.filter(F.col("trade_date") <= F.lit(asof).cast("date"))
    w = by_symbol()
    cols = {}
    for h in HORIZONS:
        cols[f"d{h}_date"] = F.lead("trade_date", h).over(w)
        cols[f"_c{h}"] = F.lead("close", h).over(w)
    for k in range(1, 6):
        cols[f"_low{k}"] = F.lead("low", k).over(w)
        cols[f"_day{k}"] = F.lead("trade_date", k).over(w)
    x = spread(b.select("symbol", "trade_date", "close", "low"), "symbol").withColumns(cols)
    x = x.select("symbol", F.col("trade_date").alias("reco_date"), F.col("close").alias("_anchor"), F.lit(True).alias("_bar"), *cols)
    known = b.select("symbol").distinct().withColumn("_known", F.lit(True))
    if "anchor_close" not in recos.columns:
        recos = recos.withColumn("anchor_close", F.lit(None).cast("double"))
    z = recos.join(x, ["symbol", "reco_date"], "left").join(known, "symbol", "left")
    good = flag(F.col("_bar") & (F.col("_anchor") != 0))
    out = {"_good": good, "anchor_close": F.when(good, F.col("_anchor")).otherwise(F.col("anchor_close"))}
    z = z.withColumns(out)
    touch = {k: flag(F.col("_good") & (F.col("stop") != 0) & (F.col(f"_low{k}") <= F.col("stop"))) for k in range(1, 6)}

    def touched(h: int) -> Column:
        any_ = touch[1]
        for k in range(2, h + 1):
            any_ = any_ | touch[k]
        mature = F.col("_good") & (F.col("stop") != 0) & F.col(f"_day{h}").isNotNull()
        return F.when(mature, any_)

    done = F.col("_good") & F.col("d10_date").isNotNull()
    status = first_match([
        (F.col("_known").isNull(), NO_BARS),
        (F.col("_bar").isNull() & F.col("anchor_close").isNotNull(), ANCHOR_KEPT), (F.col("_bar").isNull(), WAIT_CLOSE),
        (~F.col("_good"), NO_CLOSE), (done, DONE)], TRACKING)
    out = z.select(
        *[c for c in recos.columns if c not in ("anchor_close", "data_status")], "anchor_close",
        *[F.when(F.col("_good"), F.col(f"d{h}_date")).alias(f"d{h}_date") for h in HORIZONS],
        *[F.when(F.col("_good"), F.col(f"_c{h}")).alias(f"d{h}_close") for h in HORIZONS],
        *[F.when(F.col("_good") & (F.col(f"_c{h}") != 0), F.round((F.col(f"_c{h}") / F.col("_anchor") - 1) * 100, 4))
          .alias(f"ret_d{h}_pct") for h in HORIZONS],
        touched(3).alias("stop_touch_3"), touched(5).alias("stop_touch_5"),
        F.coalesce(*[F.when(touch[k], F.col(f"_day{k}")) for k in range(1, 6)]).alias("first_touch_date"),
        status.alias("data_status"))
    return _merged(out, SCORES)


def _stats(values: DataFrame, keys: list[str], v: str) -> DataFrame:
    """n, win rate, mean, median, mean win, mean loss, payoff of long (keys, v) rows."""
    x = values.filter(F.col(v).isNotNull())
    c = F.col(v)
    a = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((c > 0).cast("double")) * 100, 2).alias("win_pct"),
        F.round(F.avg(c), 4).alias("mean_pct"), F.avg(F.when(c > 0, c)).alias("_w"), F.avg(F.when(c < 0, c)).alias("_l"))
    a = a.withColumns({"mean_win_pct": F.round("_w", 4), "mean_loss_pct": F.round("_l", 4),
                       "payoff": F.round(F.col("_w") / F.abs(F.nullif(F.col("_l"), F.lit(0.0))), 4)}).drop("_w", "_l")
    return attach(a, exact_median(x, keys, v, "_m"), keys, ["_m"], nullable=keys).withColumn(
        "median_pct", F.round("_m", 4)).drop("_m")


def horizon_metrics(recos: DataFrame, horizons=HORIZONS) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f"D+{h}").alias("horizon"), F.col(f"ret_d{h}_pct").alias("v")) for h in horizons]))
    return _stats(recos.select(pairs.alias("p")).select("p.horizon", "p.v"), ["horizon"], "v")


def actual_outcomes(recos: DataFrame, txns: DataFrame, days: int = 14, sequence: str | None = None) -> DataFrame:
    """Pair each position cycle with the latest recommendation at most `days` days before its purchase.

    The as-of step runs over distinct (symbol, date) pairs, so a hot symbol stays bounded by the calendar.
    """
    recos = _set_aside(recos, OUTCOMES)
    cyc = materialise(trade_cycles(txns, sequence), "feedback-cycles")
    facts = recos.groupBy("symbol", "reco_date").agg(F.min("reco_id").alias("_rid")).withColumn("_rd", F.col("reco_date"))
    hit = last_at_or_before(facts, cyc, "symbol", "reco_date", "buy_date", ["_rid", "_rd"])
    hit = hit.filter(F.datediff("buy_date", "_rd") <= days)
    m = cyc.join(hit, ["symbol", "buy_date"])
    agg = m.groupBy(F.col("_rid").alias("reco_id")).agg(
        F.min((F.col("status") == CLOSED)).alias("_closed"), F.sum(F.col("buy_cost").cast("decimal(24,2)")).cast("double").alias("_cost"),
        F.sum(F.col("sell_net").cast("decimal(24,2)")).cast("double").alias("_net"), F.min("buy_date").alias("actual_buy_date"),
        F.max("sell_date").alias("actual_sell_date"), F.count(F.lit(1)).alias("n_cycles"))
    pnl = F.col("_net") - F.col("_cost")
    agg = agg.withColumns({
        "trade_status": F.when(F.col("_closed"), CLOSED).otherwise(OPEN),
        "actual_return_pct": F.when(F.col("_closed") & (F.col("_cost") > 0), F.round(pnl / F.col("_cost") * 100, 4)),
        "actual_result": F.when(F.col("_closed"), F.when(pnl > 0, WIN).when(pnl < 0, LOSS).otherwise(FLAT)).otherwise("")})
    z = recos.join(agg.drop("_closed", "_cost", "_net"), "reco_id", "left")
    old = F.col("data_status") if "data_status" in recos.columns else F.lit(None).cast("string")
    closed = F.col("trade_status") == CLOSED
    z = _merged(z.withColumn("exit_tracking_date", F.when(closed, F.col("actual_sell_date"))), OUTCOMES)
    return z.withColumns({
        "data_status": F.when(closed, SOLD).when((F.col("trade_status") == OPEN)
                                                & ~F.coalesce(old.startswith("D+10"), F.lit(False)), HELD).otherwise(old)})


def _is_closed() -> Column:
    return flag(F.col("trade_status") == CLOSED)


def daily_summary(recos: DataFrame, asof: str) -> DataFrame:
    """Counts plus the number of horizon cohorts due on `asof`, as (metric, value) rows."""
    day = F.lit(asof).cast("date")
    closed = _is_closed()
    a = recos.agg(
        F.count(F.lit(1)).alias("total_recommendations"),
        F.count_if(~closed & (F.coalesce("data_status", F.lit("")) != DONE)).alias("tracking"),
        F.count_if(closed).alias("actual_closed"), F.count_if(~closed & F.col("d10_date").isNotNull()).alias("completed_d10"),
        *[F.count_if(~closed & flag(F.col(f"d{h}_date") == day)).alias(f"due_d{h}") for h in HORIZONS])
    return a.unpivot([], a.columns, "metric", "value")


def due_cohorts(recos: DataFrame, asof: str) -> DataFrame:
    """Recommendations whose horizon falls on `asof`."""
    day = F.lit(asof).cast("date")
    z = recos.filter(~_is_closed())
    p = F.explode(F.array(*[F.struct(F.lit(f"D+{h}").alias("horizon"), F.col(f"d{h}_date").alias("due"),
                                     F.col(f"ret_d{h}_pct").alias("ret_pct")) for h in HORIZONS]))
    return (z.select("reco_id", "symbol", "reco_date", p.alias("p")).filter(F.col("p.due") == day)
            .select("reco_id", "symbol", "reco_date", "p.horizon", "p.ret_pct"))


def actual_summary(recos: DataFrame) -> DataFrame:
    """Results of closed recommendations; where none is closed, n is 0 and everything else null."""
    c = F.col("actual_return_pct")
    number = lambda hit: F.sum(hit.cast("long"))
    z = recos.filter(_is_closed() & c.isNotNull())
    a = z.agg(F.count(F.lit(1)).alias("n"), number(c > 0).alias("wins"), number(c < 0).alias("losses"),
              number(c == 0).alias("flats"), F.round(F.avg((c > 0).cast("double")) * 100, 2).alias("win_pct"),
              F.round(F.avg(c), 4).alias("mean_pct"), F.avg(F.when(c > 0, c)).alias("_w"), F.avg(F.when(c < 0, c)).alias("_l"))
    return a.withColumns({"mean_win_pct": F.round("_w", 4), "mean_loss_pct": F.round("_l", 4),
                          "payoff": F.round(F.col("_w") / F.abs(F.nullif(F.col("_l"), F.lit(0.0))), 4)}).drop("_w", "_l")


def weekly_summary(recos: DataFrame, asof: str) -> DataFrame:
    """Horizon metrics of recommendations not yet closed, with stop-touch rates, stamped with the ISO week."""
    z = recos.filter(~_is_closed())
    m = horizon_metrics(z)
    # Stop-touch rates cover all recommendations with a mature window.
    p = F.explode(F.array(*[F.struct(F.lit(f"D+{h}").alias("horizon"), F.col(f"stop_touch_{h}").alias("t")) for h in (3, 5)]))
    t = (recos.select(p.alias("p")).select("p.horizon", "p.t").filter(F.col("t").isNotNull()).groupBy("horizon")
         .agg(F.round(F.avg(F.col("t").cast("double")) * 100, 2).alias("stop_touch_pct"), F.count(F.lit(1)).alias("stop_touch_n")))
    day = F.lit(asof).cast("date")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return m.join(t, "horizon", "left").withColumn("iso_week", week)


def update_feedback(recos: DataFrame, txns: DataFrame, bars: DataFrame, asof: str | None = None, snaps: DataFrame | None = None,
                    sequence: str | None = None) -> DataFrame:
    """The registry after a day: executed outcomes first; what is closed stays as it is, the rest gets a lost reference price back (from
    snaps, if given) and is scored. The result is stored, and may be given to the next call: running twice changes nothing."""
    a = materialise(actual_outcomes(recos, txns, sequence=sequence), "feedback-outcomes")
    open_ = a.filter(~_is_closed())
    if snaps is not None:
        open_ = recover_reference(open_, snaps)
    return materialise(evaluate(open_, bars, asof).unionByName(a.filter(_is_closed()), allowMissingColumns=True), "feedback")


def bars_covering(stored: DataFrame, fallback: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored bars of a symbol are used only if they span [start, end]; else the fallback; else stored.

    wanted: symbol, start_date, end_date.
    """
    span = stored.groupBy("symbol").agg(F.min("trade_date").alias("_a"), F.max("trade_date").alias("_b"))
    has = fallback.select("symbol").distinct().withColumn("_fb", F.lit(True))
    pick = (wanted.join(span, "symbol", "left").join(has, "symbol", "left")
            .withColumn("_stored", flag((F.col("_a") <= F.col("start_date")) & (F.col("_b") >= F.col("end_date")))
                        | (F.col("_fb").isNull() & F.col("_a").isNotNull()))
            .select("symbol", "start_date", "end_date", "_stored"))
    s = stored.withColumn("source", F.lit("stored")).join(pick.filter("_stored"), "symbol", "left_semi")
    f = fallback.withColumn("source", F.lit("fallback")).join(pick.filter(~F.col("_stored")), "symbol", "left_semi")
    return s.unionByName(f)


__all__ = ["register", "recover_reference", "evaluate", "horizon_metrics", "actual_outcomes", "daily_summary", "due_cohorts",
           "actual_summary", "weekly_summary", "update_feedback", "bars_covering"]
