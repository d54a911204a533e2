"""Intraday confirmation and the entry gate; missing evidence fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scalars import BUSINESS_TZ, business_clock, clip, first_match, flag
from barloom.functions.scale import last_at_or_before, top_k
from barloom.operators.panel import base, by_symbol, highest, lag_col, lowest, mean, second_of, without_temps

# Routes and reasons.
MICRO, HOLD, RETEST, WAIT, MISSING = "MICRO_PLATFORM_REBREAK", "ABOVE_PLATFORM_TIGHT_HOLD", "RETEST_CONFIRMED", "WAIT", "EVIDENCE_MISSING"
REASONS = {MICRO: "平台上方缩量小平台形成，当前温和放量再突破并站稳", HOLD: "突破后在平台上方缩量横住，低点稳定且重新缓慢走强",
           RETEST: "放量突破后缩量回踩守位，且价格重新缓慢走强"}
FIRST, PENDING, NONE = ("首次突破一律WAIT，等待缩量回踩不破并重新走强", "存在一周内放量突破，但回踩、平台上方横住或小平台再突破条件未全部满足",
                        "最近一周未识别到可复核的已完成放量突破")
NO_EVIDENCE, RETREAT = "日线或14:45实时证据不足", "退潮"


def confirmation(snapshot: DataFrame, minute: DataFrame, by=("symbol",)) -> DataFrame:
    """Tail score per snapshot row. minute: by..., ts, close, volume; a day of five-minute bars is bounded."""
    by = list(by)
    back = F.row_number().over(W.partitionBy(*by).orderBy(F.col("ts").desc()))
    m = minute.withColumn("_b", back)
    n = F.col("_b")
    g = m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.when(n == 1, F.col("close"))).alias("_last"),
        F.max(F.when(n == 7, F.col("close"))).alias("_seven"), F.max_by("close", "_b").alias("_first"),
        F.avg(F.when(n <= 3, F.col("volume"))).alias("_v3"), F.avg(F.when((n > 3) & (n <= 6), F.col("volume"))).alias("_p3"))
    x = snapshot.join(g, by, "left")
    start = F.nullif(F.when(F.col("_n") >= 7, F.col("_seven")).otherwise(F.col("_first")), F.lit(0.0))
    x = x.withColumns({"last30": F.when(F.col("_n") >= 2, F.col("_last") / start - 1),
                       "vol_accel": F.when((F.col("_n") >= 6) & (F.col("_p3") > 0), F.col("_v3") / F.col("_p3"))})
    part = lambda c: F.coalesce(c, F.lit(0.0))
    score = (part(clip("pct", -5, 8) * 2) + part(clip("last30", -0.05, 0.08) * 150)
             + part(F.when(F.col("quantity_ratio").isNotNull(), F.least("quantity_ratio", F.lit(3.0)) * 3))
             + part(F.when(F.col("vol_accel").isNotNull(), F.least("vol_accel", F.lit(3.0)) * 4)))
    return without_temps(x.withColumn("confirm_score", score))


def robust_platform(bars: DataFrame) -> DataFrame:
    """Second highest of the last five known highs per bar."""
    return without_temps(base(bars).withColumn("robust_upper", second_of("h", 0, 4)))


def _events(bars: DataFrame, min_ratio: float) -> DataFrame:
    x = base(bars)
    x = x.withColumns({"_plat": second_of("h", 1, 5), "_pv": mean("v", 1, 5)})
    ratio = F.col("volume") / F.col("_pv")
    hit = flag((F.col("rn") >= 6) & (F.col("_pv") > 0) & (F.col("volume") > 0) & (F.col("close") > F.col("_plat"))
               & (F.col("_c1") <= F.col("_plat")) & (ratio >= min_ratio))
    return x.withColumn("_ev", F.when(hit, F.struct(F.col("trade_date").alias("date"), F.col("_plat").alias("platform"),
                                                    F.col("volume").alias("volume"), ratio.alias("ratio"))))


def completed_breakouts(bars: DataFrame, sessions: int = 3, min_ratio: float = 1.20) -> DataFrame:
    """Latest completed volume breakout within the last `sessions` bars, at every bar."""
    x = _events(bars, min_ratio)
    return without_temps(_latest(x, sessions).select(
        "symbol", "trade_date", F.col("_le.e.date").alias("event_date"), (F.col("_le.k") + 1).alias("sessions_ago"),
        F.col("_le.e.platform").alias("platform"), F.col("_le.e.ratio").alias("volume_ratio")).filter(F.col("event_date").isNotNull()))


def _latest(x: DataFrame, sessions: int) -> DataFrame:
    def at(k: int) -> Column:
        e = F.col("_ev") if k == 0 else F.col(f"_ev{k}")
        return F.when(e.isNotNull(), F.struct(F.lit(k).alias("k"), e.alias("e")))
    x = x.withColumns({f"_ev{k}": F.lag("_ev", k).over(by_symbol()) for k in range(1, sessions)})
    return x.withColumn("_le", F.coalesce(*[at(k) for k in range(sessions)]))


def gate_history(bars: DataFrame, sessions: int = 4, min_ratio: float = 1.20) -> DataFrame:
    """Everything the gate needs from completed bars, at every bar: event, what followed it, today's platform."""
    x = _latest(_events(bars, min_ratio), sessions)
    k = F.col("_le.k")

    def pick(ks, of) -> Column:
        return F.coalesce(*[F.when(k == i, of(i)) for i in ks])
    post = range(1, sessions)
    return x.select(
        "symbol", "trade_date", F.col("rn").alias("bars_known"), F.col("close").alias("last_close"),
        second_of("h", 0, 4).alias("today_platform"), mean("v", 0, 4).alias("mean5_volume"),
        F.col("_le.e.date").alias("event_date"), (k + 1).alias("sessions_ago"), F.col("_le.e.platform").alias("event_platform"),
        F.col("_le.e.volume").alias("event_volume"), pick(post, lambda i: lowest("l", 0, i - 1)).alias("post_low"),
        pick(post, lambda i: highest("h", 0, i - 1)).alias("post_high"), pick(post, lambda i: lowest("c", 0, i - 1)).alias("post_close"),
        pick(post, lambda i: mean("v", 0, i - 1)).alias("post_volume"), (F.coalesce(k, F.lit(0)) >= 2).alias("post_two"))


def entry_gate(pool: DataFrame, snapshot: DataFrame, minute: DataFrame, resonance: DataFrame, bars: DataFrame,
               max_extension: float = 0.03, max_undercut: float = 0.02, max_retest: float = 0.80, max_hold_amp: float = 0.06,
               max_micro_amp: float = 0.05, micro_ratio=(1.05, 1.80)) -> DataFrame:
    """PASS or WAIT per (symbol, day) of the pool, from bars before the day, the day's snapshot and its last two closes.

    snapshot: symbol, day, price, high, low, volume. minute: symbol, day, ts, close. resonance: symbol, day, state.
    """
    hist = gate_history(bars)
    cols = [c for c in hist.columns if c not in ("symbol", "trade_date")]
    probe = pool.select("symbol", F.date_sub("day", 1).alias("_before"))
    h = last_at_or_before(hist, probe, "symbol", "trade_date", "_before", cols)
    two = top_k(minute.filter(F.col("close").isNotNull()), ["symbol", "day"], [F.col("ts").desc()], 2, ["ts"])
    two = two.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("_n2"), F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("_c_last"),
                                           F.max(F.when(F.col("rn") == 2, F.col("close"))).alias("_c_prev"))
    x = (pool.withColumn("_before", F.date_sub("day", 1)).join(h, ["symbol", "_before"], "left")
         .join(snapshot.select("symbol", "day", "price", "high", "low", "volume", F.lit(True).alias("_snap")), ["symbol", "day"], "left")
         .join(two, ["symbol", "day"], "left").join(resonance.select("symbol", "day", "state"), ["symbol", "day"], "left"))
    c = F.col
    have = flag((c("bars_known") >= 6) & c("_snap"))
    ev = c("event_date").isNotNull()
    x = x.withColumns({"state": F.coalesce("state", F.lit("板块未核验")), "platform": F.coalesce("event_platform", "today_platform")})
    x = x.withColumns({
        "extension": c("price") / F.nullif(c("platform"), F.lit(0.0)) - 1,
        "undercut": F.when(c("low") > 0, F.greatest(F.lit(0.0), c("platform") / c("low") - 1)),
        "retest_ratio": F.when(ev & (c("volume") > 0), c("volume") / c("event_volume")),
        "strong_ratio": F.when(c("volume") > 0, c("volume") / F.nullif(c("mean5_volume"), F.lit(0.0))),
        "post_ratio": F.when(ev, c("post_volume") / c("event_volume")),
        "_floor": F.when(c("post_low").isNotNull() & c("low").isNotNull(), F.least("post_low", "low")),
        "_ceil": F.when(c("post_high").isNotNull() & c("high").isNotNull(), F.greatest("post_high", "high")),
        "micro_upper": F.when(c("post_two"), c("post_high")), "_mfloor": F.when(c("post_two"), c("post_low")),
        "_mvol": F.when(c("post_two"), c("post_volume"))})
    x = x.withColumns({"hold_amp": (c("_ceil") - c("_floor")) / c("_floor"), "micro_amp": (c("micro_upper") - c("_mfloor")) / c("_mfloor"),
                       "micro_volume_ratio": F.when(c("volume") > 0, c("volume") / c("_mvol")),
                       "_mext": c("price") / F.nullif(c("micro_upper"), F.lit(0.0)) - 1})

    def rising(level: str) -> Column:
        return flag((c("_n2") >= 2) & (c("_c_prev") >= c(level)) & (c("_c_last") > c("_c_prev")))
    calm = ~c("state").contains(RETREAT)
    ext_ok = flag(c("extension").between(0, max_extension))
    low_ok = flag(c("low") >= c("platform") * (1 - max_undercut))
    shrink = flag(c("retest_ratio") <= max_retest)
    retest = (flag(ev & c("sessions_ago").between(1, 3)) & ext_ok & flag(c("undercut") <= max_undercut) & shrink & rising("platform") & calm)
    done = (flag(ev & c("sessions_ago").between(2, 4) & (c("post_close") >= c("platform")) & (c("post_low") >= c("platform") * 0.98))
            & flag(c("post_ratio") <= max_retest))
    hold = done & flag(c("hold_amp") <= max_hold_amp) & ext_ok & low_ok & shrink & flag(c("price") > c("last_close")) & rising("platform") & calm
    micro = (done & flag(c("micro_amp") <= max_micro_amp) & flag(c("price") > c("micro_upper"))
             & flag(c("micro_volume_ratio").between(*micro_ratio)) & flag(c("_mext").between(0, max_extension)) & low_ok
             & rising("micro_upper") & calm)
    first = flag((c("price") > c("today_platform")) & (c("last_close") <= c("today_platform")))
    x = x.withColumns({"_have": have, "two_closes": rising("platform"), "_first": first})
    x = x.withColumn("gate_route", first_match([(~c("_have"), MISSING), (micro, MICRO), (hold, HOLD), (retest, RETEST)], WAIT))
    ok = c("gate_route").isin(MICRO, HOLD, RETEST)
    x = x.withColumns({"allowed": ok, "gate": F.when(ok, "PASS").otherwise("WAIT"), "gate_reason": first_match(
        [(~c("_have"), NO_EVIDENCE), *[(c("gate_route") == r, t) for r, t in REASONS.items()], (c("_first"), FIRST), (ev, PENDING)], NONE)})
    return without_temps(x.drop("last_close", "mean5_volume", "event_volume", "post_low", "post_high", "post_close", "post_volume",
                                "post_two", "bars_known", "event_platform", "price", "high", "low", "volume"))


def tail_window_ok(ts: str, stage: str, tz: str = BUSINESS_TZ) -> Column:
    """Event time inside the stage's decision window (business clock)."""
    hm = F.date_format(business_clock(ts, tz), "HH:mm")
    return F.when(F.lit(stage) == "precheck", hm.between("14:32", "14:44")).otherwise(hm.between("14:40", "14:55"))


def same_universe(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symbols present on one side only; empty means the same universe."""
    x = a.select("symbol").exceptAll(b.select("symbol")).withColumn("side", F.lit("first"))
    return x.unionByName(b.select("symbol").exceptAll(a.select("symbol")).withColumn("side", F.lit("second")))
