"""Screening stages with full audit: every row keeps its score, rank, selection and reason.

Ranks come from a histogram of scores per date (functions.scale), so no date is sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scalars import as_int, first_match, flag
from barloom.functions.scale import attach, running_sums, score_histogram, top_k

# Stage names and risk labels.
STAGE_NAMES = ("一级粗筛", "二级结构筛选", "三级生命周期筛选")
RISK_MA_UNKNOWN, RISK_MA_BELOW, RISK_MA_FLAT = "MA25证据不足", "收盘价未站上MA25", "MA25未上扬"
RISK_AMP, RISK_FAST, RISK_DIR = "近5日波动仍偏大", "近10日速度偏快", "20日方向仍偏弱"
RISK2 = ("量价/换手整理证据不足", "振幅、量能、换手或短期趋势尚未形成两类收敛支持", "短波动仍偏大",
         "10日速度仍偏快，整理可能未完成", "40日趋势偏弱", "距离短周期稳健上沿较远")
LIFE = ("长期下降趋势修复", "右上角/高位趋势", "中期上升趋势延续", "中段/待确认")
RISK3 = ("长期下降趋势中的修复/反弹，降级", "40日加速较大：仅作趋势成熟风险提示，不单独判尾端", "120日趋势偏弱")


@dataclass(frozen=True)
class RuleSet:
    """Thresholds and variants of a generation of rules."""

    generation: int = 5
    max_amp5: float = 0.18
    max_ret10: float = 0.20
    min_ret10: float = -0.12
    upper_band: tuple[float, float] = (-0.10, 0.06)
    core_zone: tuple[float, float] = (-0.02, 0.03)
    wide_zone: tuple[float, float] = (-0.05, 0.05)
    reaccel: tuple[float, float] = (0.02, 0.06)
    platform_days: tuple[int, int] = (3, 5)
    caps: tuple[int | None, int | None, int | None] = (None, None, None)


V5 = RuleSet()
V4 = RuleSet(generation=4, caps=(150, 30, 10))


def rank_and_audit(df: DataFrame, score: str, min_n: int | None = None, max_n: int | None = None,
                   eligible: str | None = None, stage: str = "", by: tuple[str, ...] = ("trade_date",),
                   symbol: str = "symbol") -> DataFrame:
    """Eligibility first, optional soft capacity with ties extended up to max_n.

    Adds stage_rank, selected, min_n, max_n, selected_n, cutoff_score, reason. No capacity: all eligible.
    """
    by = list(by)
    elig = F.lit(True) if eligible is None else flag(F.col(eligible))
    hist = score_histogram(df, by, score, elig)
    group = W.partitionBy(*by)
    lowest = F.min(F.when(F.col("n_elig") > 0, F.col(score))).over(group)
    if min_n is None and max_n is None:
        hist = hist.withColumns({"cutoff_score": lowest, "selected_n": F.col("total_elig")})
        chosen = elig
    else:
        eff_min = max(1, int(min_n or max_n))
        eff_max = max(eff_min, int(max_n)) if max_n else None
        short = F.col("total_elig") <= F.lit(eff_min if min_n is None else int(min_n))
        at = F.max(F.when(F.col("cum_elig") >= eff_min, F.col(score))).over(group)
        hist = hist.withColumn("cutoff_score", F.when(short, lowest).otherwise(at))
        hit = F.col(score) == F.col("cutoff_score")
        hist = hist.withColumns({"_natural": F.max(F.when(hit, F.col("cum_elig"))).over(group),
                                 "_above": F.max(F.when(hit, F.col("cum_elig") - F.col("n_elig"))).over(group)})
        size = F.greatest(F.lit(eff_min), F.col("_natural"))
        if eff_max is not None:
            size = F.least(F.lit(eff_max), size)
        hist = hist.withColumn("selected_n", F.when(short, F.col("total_elig")).otherwise(size))
        chosen = elig & (F.col("_short") | flag(F.col(score) >= F.col("cutoff_score")))
        hist = hist.withColumn("_short", short)
        if eff_max is not None:
            # Only a tie group that overflows max_n needs an order by symbol: a bounded top-k per date.
            over = hist.filter(hit & ~short & (F.col("_natural") > F.col("selected_n"))).select(
                *by, score, (F.col("selected_n") - F.col("_above")).alias("_take"))
            tie = attach(df.filter(elig).select(*by, score, symbol), over, [*by, score], ["_take"], how="inner")
            tie = top_k(tie, by, [F.col(symbol).asc()], eff_max, [symbol]).filter(F.col("rn") <= F.col("_take"))
            edge = tie.groupBy(*by).agg(F.max(symbol).alias("_edge"))
            hist = attach(hist, edge, by, ["_edge"])
            chosen = chosen & (F.col("_edge").isNull() | F.col("_short") | (F.col(score) > F.col("cutoff_score"))
                               | (F.col(symbol) <= F.col("_edge")))
    extra = [c for c in ("_short", "_edge") if c in hist.columns]
    z = attach(df, hist, [*by, score], ["min_rank", "cutoff_score", "selected_n", *extra], nullable=[score])
    cap_lo, cap_hi = F.lit(min_n).cast("int"), F.lit(max_n).cast("int")
    z = (z.withColumnRenamed("min_rank", "stage_rank").withColumn("selected", flag(chosen))
         .withColumns({"min_n": cap_lo, "max_n": cap_hi}))
    return z.withColumn("reason", _reason(score, min_n, max_n, eligible, stage)).drop(*extra)


def _reason(score: str, min_n, max_n, eligible, stage: str) -> Column:
    rules = []
    if eligible is not None:
        rules.append((~flag(F.col(eligible)), f"未入选：未满足{stage}最低资格条件"))
    if min_n is None and max_n is None:
        rules.append((F.col("selected"), f"入选：满足{stage}资格条件；本阶段不设置数量下限或上限"))
        return first_match(rules, f"未入选：未满足{stage}资格条件")
    rules.append((F.col("selected"), F.concat(F.lit(f"入选：{score}="), F.col(score).cast("string"),
                                              F.lit(f"；软容量{min_n}-{max_n}只，本次实际"),
                                              F.col("selected_n").cast("string"), F.lit("只"))))
    return first_match(rules, f"未入选：满足基础条件，但位于本次软容量边界之外（{min_n}-{max_n}只）")


def ordered_position(df: DataFrame, by: list[str], scores: list[str], symbol: str, out: str,
                     prefix: int = 4) -> DataFrame:
    """row_number over (scores desc, symbol asc) per group without sorting a group in one task.

    Position = rows with a better score tuple (histogram) + rows before this symbol inside the tie,
    counted by symbol prefix first.
    """
    hist = df.groupBy(*by, *scores).agg(F.count(F.lit(1)).alias("_n"))
    down = (W.partitionBy(*by).orderBy(*[F.col(s).desc_nulls_last() for s in scores])
            .rowsBetween(W.unboundedPreceding, -1))
    hist = hist.select(*by, *scores, F.coalesce(F.sum("_n").over(down), F.lit(0)).alias("_better"))
    z = attach(df, hist, [*by, *scores], ["_better"], nullable=scores)
    # `_better` is unique per score tuple, so it stands for the tie group.
    z = z.withColumn("_chunk", F.substring(symbol, 1, prefix))
    z = running_sums(z, [*by, "_better"], "_chunk", [symbol], {"_tie": F.lit(1)})
    return z.withColumn(out, (F.col("_better") + F.col("_tie")).cast("int")).drop("_better", "_tie", "_chunk")


def rank_and_audit_v4(df: DataFrame, score: str, max_n: int, eligible: str | None = None, stage: str = "",
                      by: tuple[str, ...] = ("trade_date",), symbol: str = "symbol") -> DataFrame:
    """First-method rank over all rows; the first max_n eligible rows are selected."""
    by = list(by)
    elig = F.lit(True) if eligible is None else flag(F.col(eligible))
    z = ordered_position(df, by, [score], symbol, "stage_rank")
    top = top_k(df.filter(elig).select(*by, symbol, score), by,
                [F.col(score).desc_nulls_last(), F.col(symbol).asc()], max_n, [symbol]).select(*by, symbol)
    z = attach(z, top.withColumn("_top", F.lit(True)), [*by, symbol], ["_top"])
    z = z.withColumn("selected", flag(F.col("_top"))).drop("_top")
    rank = F.col("stage_rank").cast("string")
    reason = first_match([(~elig, f"未入选：未满足{stage}最低资格条件"),
                          (F.col("selected"), F.concat(F.lit(f"入选：按{score}排序第"), rank, F.lit(f"名；本阶段上限{max_n}只")))],
                         F.concat(F.lit("未入选：满足基础条件，但排名第"), rank, F.lit(f"名，超出{max_n}只上限")))
    return z.withColumn("reason", reason)


def stage1_score(x: DataFrame, rules: RuleSet = V5) -> DataFrame:
    c = F.col
    above = c("ma20_dist") >= 0 if rules.generation == 4 else c("ma25_dist") > 0
    parts = {"ev_dir20": as_int(c("ret20") >= 0) * 2, "ev_above_ma": as_int(above) * 2,
             "ev_amp": as_int(c("amp5") <= rules.max_amp5), "ev_not_hot": as_int(c("ret10") <= rules.max_ret10),
             "ev_not_crash": as_int(c("ret10") >= rules.min_ret10),
             "ev_near_upper": as_int(c("robust_upper5_dist").between(*rules.upper_band))}
    x = x.withColumns(parts).withColumn("stage1_score", sum((c(p) for p in list(parts)[1:]), c("ev_dir20")))
    live = flag(c("latest_close") > 0)
    soft = [(c("amp5") > rules.max_amp5, RISK_AMP), (c("ret10") > rules.max_ret10, RISK_FAST), (c("ret20") < 0, RISK_DIR)]
    if rules.generation == 4:
        return x.withColumns({"stage1_pass": live, "stage1_risk": first_match(soft, "")})
    hard = [(c("ma25_dist").isNull() | c("ma25_slope1").isNull(), RISK_MA_UNKNOWN),
            (c("ma25_dist") <= 0, RISK_MA_BELOW), (c("ma25_slope1") <= 0, RISK_MA_FLAT)]
    return x.withColumns({
        "stage1_pass": live & flag(c("limit_up_25")) & flag(c("ma25_dist") > 0) & flag(c("ma25_slope1") > 0),
        "close_above_ma25": flag(c("ma25_dist") > 0), "ma25_rising": flag(c("ma25_slope1") > 0),
        "stage1_risk": first_match(hard + soft, "")})


def stage2_score(x: DataFrame, rules: RuleSet = V5) -> DataFrame:
    c = F.col
    base = flag((c("amp5") <= rules.max_amp5) & (c("ret10") <= rules.max_ret10))
    x = x.withColumns({
        "base_calm": base, "amp_narrow": flag(c("amp_contraction") <= 1.0),
        "trend_alive": flag(c("ret40") >= 0),
        "ma_aid": flag((c("ma20_dist") > 0) & (c("ma30_slope5") > 0)),
        "upper_core": flag(c("robust_upper5_dist").between(*rules.core_zone)),
        "upper_wide": flag(c("robust_upper5_dist").between(*rules.wide_zone)),
        "reaccel": flag(c("ret1").between(*rules.reaccel))})
    zone = F.when(c("upper_core"), 4).when(c("upper_wide"), 2).otherwise(0)
    tail = [(c("amp5") > rules.max_amp5, RISK2[2]), (c("ret10") > rules.max_ret10, RISK2[3]),
            (c("ret40") < 0, RISK2[4]), (F.abs(c("robust_upper5_dist")) > 0.08, RISK2[5])]
    score = as_int(c("trend_alive")) * 3 + as_int(c("ma_aid")) + zone + as_int(c("reaccel"))
    if rules.generation == 4:
        return (x.withColumn("mature", base).withColumn("stage2_score", as_int(c("mature")) * 3 + score)
                .withColumns({"stage2_pass": c("mature") & c("trend_alive"), "stage2_risk": first_match(tail, "")}))
    x = x.withColumns({
        "mature": base & flag(c("evidence_available") >= 2) & flag(c("evidence_support") >= 2),
        "right_side": c("trend_alive") & c("ma_aid"),
        "short_platform": flag(c("platform_days").between(*rules.platform_days)) & ~flag(c("platform_over_week"))})
    x = x.withColumn("stage2_score", as_int(c("mature")) * 3 + as_int(c("amp_narrow"))
                     + as_int(c("liquidity_contraction")) + as_int(c("decline_stopped")) + score)
    head = [(c("evidence_available") < 2, RISK2[0]), (c("evidence_support") < 2, RISK2[1])]
    return x.withColumns({
        "stage2_pass": (c("mature") & c("right_side") & c("short_platform") & ~F.coalesce(c("n_shape"), F.lit(True))
                        & flag(c("breakout_eligible"))),
        "stage2_risk": first_match(head + tail, "")})


def pct_rank_average(x: DataFrame, col: str, out: str, by: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """Average-tie percentile over non-null values, from the value histogram."""
    h = score_histogram(x, list(by), col)
    h = h.withColumn(out, F.when(F.col(col).isNotNull(),
                                 # ascending min-rank = n - descending min-rank - ties + 2
                                 (F.col("n_scored") - F.col("min_rank") - F.col("ties") + 2
                                  + (F.col("ties") - 1) / 2) / F.col("n_scored")))
    return attach(x, h, [*by, col], [out], nullable=[col])


def stage3_score(x: DataFrame, by: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    c = F.col
    if "stage2_score" not in x.columns:
        x = x.withColumn("stage2_score", F.lit(None).cast("int"))
    x = x.withColumn("_any2", F.lit(True))
    x = pct_rank_average(x, "stage2_score", "_pct", by)
    seen = x.groupBy(*by).agg(F.count("stage2_score").alias("_seen"))
    x = attach(x, seen, list(by), ["_seen"])
    long_ok = flag((c("ret120") >= 0) & (c("ma120_slope20") >= 0))
    down = flag((c("position_all") < 0.45) & (c("ret120") < 0) & (c("ma120_slope20") < 0))
    x = x.withColumns({"long_ok": long_ok, "down_rebound": down}).withColumn(
        "right_upper", flag(c("position_all") >= 0.65) & c("long_ok"))
    carry = F.when(c("_seen") > 0, c("_pct") * 3).otherwise(0.0)
    x = x.withColumn("stage2_carry", carry)
    return x.withColumns({
        "stage3_score": (as_int(c("long_ok")) * 3 + as_int(c("right_upper")) * 2 + as_int(c("ret40") >= 0)
                         + c("stage2_carry") - as_int(c("down_rebound")) * 6),
        "lifecycle": first_match([(c("down_rebound"), LIFE[0]), (c("right_upper"), LIFE[1]), (c("long_ok"), LIFE[2])],
                                 LIFE[3]),
        "stage3_pass": ~c("down_rebound"),
        "stage3_risk": first_match([(c("down_rebound"), RISK3[0]), (c("ret40") > 0.50, RISK3[1]),
                                    (c("ret120") < 0, RISK3[2])], "")}).drop("_pct", "_seen", "_any2")


def _run(x: DataFrame, n: int, rules: RuleSet, min_n, max_n, by, symbol="symbol") -> DataFrame:
    score, ok, stage = f"stage{n}_score", f"stage{n}_pass", STAGE_NAMES[n - 1]
    if rules.generation == 4:
        return rank_and_audit_v4(x, score, max_n or rules.caps[n - 1], ok, stage, by, symbol)
    if n == 3 and max_n is not None:
        min_n = max_n
    return rank_and_audit(x, score, min_n, max_n, ok, stage, by, symbol)


def stage1(x: DataFrame, min_n=None, max_n=None, rules: RuleSet = V5, by=("trade_date",)) -> DataFrame:
    return _run(stage1_score(x, rules), 1, rules, min_n, max_n, by)


def stage2(x: DataFrame, min_n=None, max_n=None, rules: RuleSet = V5, by=("trade_date",)) -> DataFrame:
    return _run(stage2_score(x, rules), 2, rules, min_n, max_n, by)


def stage3(x: DataFrame, max_n=None, rules: RuleSet = V5, by=("trade_date",)) -> DataFrame:
    return _run(stage3_score(x, by), 3, rules, None, max_n, by)


AUDIT_COLUMNS = ("stage_rank", "selected", "min_n", "max_n", "selected_n", "cutoff_score", "reason")


def selected_only(audit: DataFrame) -> DataFrame:
    return audit.filter("selected").drop(*AUDIT_COLUMNS)


STAGE2_EVIDENCE = (
    "amp_prev10", "amp_contraction", "vol5", "vol_prev10", "vol_contraction", "turnover5", "turnover_prev10",
    "turnover_contraction", "ma5_slope3", "ma10_slope3", "evidence_available", "evidence_support",
    "consolidation_state", "base_calm", "amp_narrow", "liquidity_contraction", "decline_stopped", "mature",
    "trend_alive", "ma_aid", "upper_core", "upper_wide", "reaccel", "stage2_score", "stage2_pass", "stage2_risk")


def attach_stage2_evidence(pack: DataFrame, audit2: DataFrame, keys=("trade_date", "symbol")) -> DataFrame:
    """Replace the evidence columns of a later pack by those of the stage-2 audit (one row per key)."""
    cols = [c for c in STAGE2_EVIDENCE if c in audit2.columns]
    one = audit2.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col("stage_rank")).alias("_e"))
    one = one.select(*keys, *[F.col(f"_e.{c}").alias(c) for c in cols])
    return attach(pack.drop(*cols), one, list(keys), cols)


# Outcome codes and the support names shown in reasons.
OUT_TREND, OUT_STRUCT, OUT_OK, OUT_LOWER = "MID_TERM_TREND_WEAK", "STRUCTURE_NOT_MATURE", "QUALIFIED", "LOWER_PRIORITY"
SUPPORT_LABELS = (("amp_narrow", "振幅收敛"), ("liquidity_contraction", "成交量/换手收敛"), ("decline_stopped", "短期止跌"))


def align_candidates(audit3: DataFrame, cap: int = 50, by: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """Deterministic gate after the third stage: three supports, overheating penalty, capacity; all rows explained."""
    if cap < 1:
        raise ValueError("cap must be a positive integer")
    c, by = F.col, list(by)
    x = audit3.drop(*AUDIT_COLUMNS)
    for name in ("stage2_score", "ret1", "ret40"):
        if name not in x.columns:
            x = x.withColumn(name, F.lit(None).cast("double"))
    x = x.withColumns({"life_ok": flag(c("stage3_pass")), "structure_ok": flag(c("evidence_support") >= 3)})
    x = x.withColumns({
        "qualified": c("life_ok") & c("structure_ok"),
        "heat_penalty": as_int(c("ret1") > 0.06) * 3 + as_int(c("ret40") > 0.80) * 2})
    x = x.withColumn("align_score", F.coalesce(c("stage3_score"), F.lit(-999.0)) + F.coalesce(c("stage2_score"), F.lit(0))
                     - c("heat_penalty"))
    elig = x.filter("qualified").select(*by, "symbol", "align_score", "stage3_score")
    pos = ordered_position(elig, by, ["align_score", "stage3_score"], "symbol", "align_rank")
    x = attach(x, pos, [*by, "symbol"], ["align_rank"])
    total = elig.groupBy(*by).agg(F.count(F.lit(1)).alias("n_qualified"))
    x = attach(x, total, by, ["n_qualified"])
    x = x.withColumns({"selected": flag(c("align_rank") <= cap), "cap": F.lit(cap),
                       "selected_n": F.least(F.lit(cap), F.coalesce(c("n_qualified"), F.lit(0)))})
    absent = F.array_compact(F.array(*[F.when(~flag(c(k)), F.lit(v)) for k, v in SUPPORT_LABELS if k in x.columns]))
    absent = F.when(F.size(absent) > 0, F.array_join(absent, "、")).otherwise("至少一类结构证据")
    place = F.concat(c("align_rank").cast("string"), F.lit("/"), c("n_qualified").cast("string"))
    sup = F.coalesce(c("evidence_support"), F.lit(0))
    detail = F.when(F.coalesce(c("stage3_risk"), F.lit("")) != "", c("stage3_risk")).otherwise("250日生命周期未通过")
    x = x.withColumn("outcome", first_match([(~c("life_ok"), OUT_TREND), (sup < 3, OUT_STRUCT), (c("selected"), OUT_OK)],
                                            OUT_LOWER))
    reason = first_match([
        (c("outcome") == OUT_TREND, F.concat(F.lit("程序前置淘汰："), detail)),
        (c("outcome") == OUT_STRUCT, F.concat(F.lit("程序前置淘汰：三类整理成熟证据仅"), sup.cast("int").cast("string"),
                                              F.lit("/3，缺少"), absent)),
        (c("outcome") == OUT_OK, F.concat(F.lit("入选：三类整理成熟证据3/3且250日生命周期通过；对齐排名"), place,
                                          F.lit(f"，输入上限{cap}只")))],
        F.concat(F.lit("程序前置淘汰：基础资格通过，但对齐排名"), place, F.lit(f"位于输入上限{cap}只之外")))
    return x.withColumn("outcome_reason", reason).drop("n_qualified")


def outcome_counts(audit: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return audit.groupBy(*by, "outcome").agg(F.count(F.lit(1)).alias("n"))
