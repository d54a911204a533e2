"""Limit-price and breakout evidence at every bar, from bounded frames only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import first_match, flag, limit_board, limit_pct
from barloom.operators.features import far_columns, near_columns
from barloom.operators.panel import (base, blocks, by_symbol, highest, lag_col, lowest, mean, second_of, shifted,
                                     without_temps)

# Stage and route names, and the reason given with each.
ROUTE_MICRO, ROUTE_HOLD, ROUTE_RETEST = "MICRO_PLATFORM_REBREAK", "ABOVE_PLATFORM_TIGHT_HOLD", "RETEST_RENEWED_STRENGTH"
STAGE_OK, STAGE_WAIT, STAGE_SETTLE = "EFFECTIVE_BREAKOUT_CONFIRMED", "BREAKOUT_AWAIT_RETEST", "RETEST_STABILIZING"
STAGE_READY, STAGE_NONE = "READY_FOR_BREAKOUT", "INELIGIBLE"
REASONS = {
    ROUTE_MICRO: "放量突破后在平台上方形成缩量小平台，并温和放量再次突破",
    ROUTE_HOLD: "放量突破后在平台上方缩量横住，低点稳定并重新缓慢走强",
    ROUTE_RETEST: "放量突破后缩量回踩守位，价格重新缓慢走强",
    STAGE_WAIT: "首次放量突破，仅观察，等待缩量回踩确认",
    STAGE_SETTLE: "突破后处于一周内确认窗，守位/缩量/横住或小平台再突破条件尚未全部成立",
    STAGE_READY: "紧凑缩量平台形成，尚未出现放量突破",
    STAGE_NONE: "未形成合格的短周期缩量平台或呈N型走势",
    "MISSING": "量价证据不足",
}


def limit_columns(x: DataFrame, code: str = "symbol", name: str | None = None) -> DataFrame:
    """Row level: is this close at the board's rounded limit price."""
    x = x.withColumn("_lim", limit_pct(code, name))
    ok = F.col("_raw1").isNotNull() & F.col("raw_close").isNotNull() & (F.col("_raw1") > 0)
    rate = (F.lit(1).cast("decimal(6,2)") + F.col("_lim").cast("decimal(6,2)") / 100).cast("decimal(4,2)")
    price = F.round(F.col("_raw1").cast("decimal(18,6)") * rate, 2)
    gap = F.abs(F.col("raw_close").cast("decimal(18,6)") - price)
    x = x.withColumn("_pct", F.when(ok, (F.col("raw_close") / F.col("_raw1") - 1) * 100))
    return x.withColumn("_hit", flag((gap <= F.lit("0.005").cast("decimal(4,3)"))
                                     & F.col("_pct").between(F.col("_lim") - 0.25, F.col("_lim") + 0.80)))


def limit_window(x: DataFrame, sessions: int = 25, code: str = "symbol", name: str | None = None) -> DataFrame:
    w = by_symbol().rowsBetween(-(sessions - 1), 0)
    return x.withColumns({
        "limit_up_count_25": F.count_if("_hit").over(w).cast("int"),
        "limit_up_last_date": F.max(F.when(F.col("_hit"), F.col("trade_date"))).over(w),
        "limit_verified_days": F.count("_pct").over(w).cast("int"),
        "max_daily_pct_25": F.max("_pct").over(w),
        "limit_board": limit_board(code, name)}).withColumn("limit_up_25", F.col("limit_up_count_25") > 0)


def limit_up_evidence(bars: DataFrame, sessions: int = 25, code: str = "symbol", name: str | None = None) -> DataFrame:
    """Closes at the board's rounded limit price over the last `sessions` transitions, on unadjusted closes."""
    x = limit_window(limit_columns(base(bars), code, name), sessions, code, name)
    return x.select(*bars.columns, *LIMIT_COLUMNS)


def platform_columns(x: DataFrame, max_amp: float = 0.10, vol_slack: float = 1.05) -> DataFrame:
    """Row level: the widest compact platform of 3, 4 or 5 bars that ends with this bar."""
    def compact(d: int) -> Column:
        hi, lo = highest("h", 0, d - 1), lowest("l", 0, d - 1)
        mv, pv = mean("v", 0, d - 1), mean("v", d, 2 * d - 1)
        amp_ok = (lo > 0) & ((hi - lo) / lo <= max_amp)
        vol_ok = pv.isNull() | mv.isNull() | (mv <= pv * vol_slack)
        upper = F.coalesce(second_of("h", 0, d - 1), hi)
        return F.when(flag((F.col("rn") >= d) & amp_ok & vol_ok),
                      F.struct(F.lit(d).alias("days"), upper.alias("upper"), mv.alias("mean_vol")))

    arr = F.array(*[lag_col("c", i) for i in range(9, -1, -1)])
    complete = None
    for k in "chl":
        for i in range(10):
            ok = lag_col(k, i).isNotNull()
            complete = ok if complete is None else complete & ok
    x = x.withColumns({"_cw": F.coalesce(compact(5), compact(4), compact(3)), "_ready": complete,
                       "_c10": F.when(complete, arr)})
    head = F.slice("_c10", 1, 7)
    x = x.withColumn("_pk", F.array_position(head, F.array_max(head)).cast("int"))
    x = x.withColumn("_rest", F.slice("_c10", F.col("_pk") + 1, 10 - F.col("_pk")))
    x = x.withColumn("_tr", F.array_min("_rest"))
    trough_at = F.array_position("_rest", F.col("_tr")) + F.col("_pk")
    return x.withColumn("_nshape", flag((trough_at < 10)
                                        & (F.col("_tr") / F.element_at("_c10", F.col("_pk")) - 1 <= -0.08)
                                        & (F.col("close") / F.col("_tr") - 1 >= 0.05)))


def event_window(x: DataFrame, event_ratio: float = 1.20) -> DataFrame:
    """The platform before this bar, and whether this bar breaks it on volume."""
    x = x.withColumn("_plat", F.lag("_cw").over(by_symbol()))
    ratio = F.col("volume") / F.col("_plat.mean_vol")
    is_event = flag((F.col("rn") >= 6) & (F.col("_plat.upper") > 0) & (F.col("_plat.mean_vol") > 0)
                    & (F.col("_c1") <= F.col("_plat.upper")) & (F.col("close") > F.col("_plat.upper"))
                    & (ratio >= event_ratio))
    return x.withColumn("_ev", F.when(is_event, F.struct(
        F.col("_plat.days").alias("days"), F.col("_plat.upper").alias("upper"), F.col("volume").alias("volume"),
        ratio.alias("ratio"), F.col("trade_date").alias("date"))))


def breakout_columns(x: DataFrame) -> DataFrame:
    """The latest event of the last five bars, its confirmation routes and the stage."""
    def event_at(k: int) -> Column:
        e = F.col("_ev") if k == 0 else F.col(f"_ev{k}")
        return F.when(e.isNotNull(), F.struct(F.lit(k).alias("k"), e.alias("e")))

    x = x.withColumns({f"_ev{k}": F.lag("_ev", k).over(by_symbol()) for k in range(1, 5)})
    x = x.withColumn("_last", F.coalesce(*[event_at(k) for k in range(5)]))
    k = F.col("_last.k")
    upper, ev_vol = F.col("_last.e.upper"), F.col("_last.e.volume")

    def pick(ks, of) -> Column:
        return F.coalesce(*[F.when(k == i, of(i)) for i in ks])

    x = x.withColumns({
        "_al": pick(range(1, 5), lambda i: lowest("l", 0, i - 1)), "_ah": pick(range(1, 5), lambda i: highest("h", 0, i - 1)),
        "_ac": pick(range(1, 5), lambda i: lowest("c", 0, i - 1)), "_av": pick(range(1, 5), lambda i: mean("v", 0, i - 1)),
        "_first": pick(range(1, 5), lambda i: lag_col("l", i - 1)),
        "_mh": pick((3, 4), lambda i: highest("h", 1, i - 1)), "_ml": pick((3, 4), lambda i: lowest("l", 1, i - 1)),
        "_mm": pick((2, 3, 4), lambda i: mean("v", 1, i - 1))})
    c, low = F.col("close"), F.col("low")
    no_n = ~F.col("_nshape")
    ret1 = c / F.col("_c1") - 1
    x = x.withColumns({
        "_holds": flag((k >= 1) & (F.col("_al") >= upper * 0.98)),
        "_vr": F.when((k >= 1) & (ev_vol > 0), F.col("_av") / ev_vol),
        "_renew": flag((k >= 1) & (c >= upper) & (ret1 > 0) & (ret1 <= 0.03)),
        "_hamp": F.when(F.col("_al") > 0, (F.col("_ah") - F.col("_al")) / F.col("_al")),
        "_mamp": F.when(F.col("_ml") > 0, (F.col("_mh") - F.col("_ml")) / F.col("_ml")),
        "_mratio": F.when(F.col("_mm") > 0, F.col("volume") / F.col("_mm"))})
    shrink = flag(F.col("_vr") <= 0.80)
    retest = flag(k.between(1, 3) & F.col("_holds") & shrink & F.col("_renew") & no_n)
    hold = flag(k.between(2, 4) & F.col("_holds") & shrink & (F.col("_ac") >= upper) & (low >= F.col("_first") * 0.98)
                & (F.col("_hamp") <= 0.06) & F.col("_renew") & (c / upper - 1 <= 0.05) & no_n)
    micro = flag(k.between(3, 4) & F.col("_holds") & (F.col("_mamp") <= 0.05) & (F.col("_mm") <= ev_vol * 0.80)
                 & (F.col("_ml") >= upper * 0.98) & (c > F.col("_mh")) & F.col("_mratio").between(1.05, 1.80)
                 & (c / F.col("_mh") - 1 <= 0.03) & no_n)
    x = x.withColumn("_route", first_match([(micro, ROUTE_MICRO), (hold, ROUTE_HOLD), (retest, ROUTE_RETEST)], ""))

    ready = F.col("_ready")
    has = F.col("_last").isNotNull()
    sure = F.col("_route") != ""
    flat = F.col("_cw").isNotNull() & no_n
    stage = first_match([(~ready, STAGE_NONE), (has & sure, STAGE_OK), (has & (k == 0), STAGE_WAIT),
                         (has, STAGE_SETTLE), (flat, STAGE_READY)], STAGE_NONE)
    reason = first_match([(~ready, REASONS["MISSING"]),
                          *[(F.col("_route") == r, REASONS[r]) for r in (ROUTE_MICRO, ROUTE_HOLD, ROUTE_RETEST)],
                          (has & (k == 0), REASONS[STAGE_WAIT]), (has, REASONS[STAGE_SETTLE]),
                          (flat, REASONS[STAGE_READY])], REASONS[STAGE_NONE])
    on = lambda v: F.when(ready & has, v)
    return x.withColumns({
        "breakout_stage": stage, "breakout_eligible": flag(ready & has & no_n),
        "breakout_confirmed": flag(ready & has & sure),
        "platform_days": F.when(~ready, 0).when(has, F.col("_last.e.days")).otherwise(F.coalesce(F.col("_cw.days"), F.lit(0))),
        "platform_over_week": F.lit(False),
        "platform_upper": F.when(ready, F.when(has, upper).otherwise(F.col("_cw.upper"))),
        "breakout_date": on(F.col("_last.e.date")), "sessions_since_breakout": on(k),
        "breakout_volume_ratio": on(F.col("_last.e.ratio")), "retest_volume_ratio": on(F.col("_vr")),
        "retest_holds": flag(ready & has & F.col("_holds")), "renewed": flag(ready & has & F.col("_renew")),
        "n_shape": flag(ready & F.col("_nshape")),
        "breakout_route": F.when(ready & has, F.col("_route")).otherwise(""),
        "hold_amp": on(F.col("_hamp")), "micro_upper": on(F.col("_mh")), "micro_volume_ratio": on(F.col("_mratio")),
        "breakout_reason": reason})


def breakout_evidence(bars: DataFrame) -> DataFrame:
    """Platform, breakout event, its confirmation routes and the resulting stage at every bar."""
    x = breakout_columns(event_window(platform_columns(base(bars))))
    return x.select(*bars.columns, *BREAKOUT_COLUMNS)


LIMIT_COLUMNS = ["limit_up_25", "limit_up_count_25", "limit_up_last_date", "limit_board", "limit_verified_days",
                 "max_daily_pct_25"]
BREAKOUT_COLUMNS = ["breakout_stage", "breakout_eligible", "breakout_confirmed", "platform_days", "platform_over_week",
                    "platform_upper", "breakout_date", "sessions_since_breakout", "breakout_volume_ratio",
                    "retest_volume_ratio", "retest_holds", "renewed", "n_shape", "breakout_route", "hold_amp",
                    "micro_upper", "micro_volume_ratio", "breakout_reason"]


def metrics_panel(bars: DataFrame, depth: int = 280) -> DataFrame:
    """Features and evidence together in the same three passes: the input of every screening stage."""
    name = "name" if "name" in bars.columns else None
    x = platform_columns(near_columns(blocks(base(bars)), depth))
    has_raw = "raw_close" in bars.columns
    if has_raw:
        x = limit_columns(x, name=name)
    x = event_window(shifted(x, depth))
    if has_raw:
        x = limit_window(x, name=name)
    else:
        x = x.withColumn("limit_up_25", F.lit(False))
    return without_temps(breakout_columns(far_columns(x, depth)))
