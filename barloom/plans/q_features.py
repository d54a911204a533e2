"""Queries over features, evidence, screening stages and the candidate gate."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from barloom.operators.evidence import breakout_evidence, limit_up_evidence, metrics_panel
from barloom.operators.features import features, features_asof, features_for_registry
from barloom.operators import screen
from barloom.plans.catalog import BARS, BREAK, LIMIT, RAW, SYM, feature_sql, query, r6
from barloom.plans.funnel import funnel, funnel_counts, revision_replay, without_history
from barloom.session import materialise
from barloom.sources import views as v

FEAT = f"WITH {BARS}, {feature_sql(250)} "
GROUPS = {
    "feature_returns": "ret1 ret5 ret10 ret20 ret40 ret60 ret120 latest_close",
    "feature_moving_averages": "ma5 ma10 ma20 ma25 ma30 ma60 ma120 ma20_dist ma25_dist",
    "feature_slopes": "ma5_slope3 ma10_slope3 ma25_slope1 ma30_slope5 ma60_slope10 ma120_slope20",
    "feature_ranges": "amp5 amp_prev10 amp_contraction",
    "feature_volume_turnover": "vol5 vol_prev10 vol_contraction turnover5 turnover_prev10 turnover_contraction",
    "feature_highs_position": "dist_high20 dist_high_all position_all",
    "feature_levels": "robust_upper5 robust_upper5_dist low5 low10 low5_dist low10_dist",
}


def _features_query(name: str, cols: str):
    @query(name, FEAT + r6(f"SELECT symbol, trade_date, {', '.join(cols.split())} FROM feat", cols))
    def _(spark, sf):
        return features(v.bars(spark, sf), 250).select("symbol", "trade_date", *cols.split())


for _n, _c in GROUPS.items():
    _features_query(_n, _c)


@query("feature_contraction_votes", FEAT + """SELECT symbol, trade_date, decline_stopped, liquidity_contraction, evidence_available,
  evidence_support, consolidation_state FROM feat""")
def _(spark, sf):
    return features(v.bars(spark, sf), 250).select("symbol", "trade_date", "decline_stopped", "liquidity_contraction",
                                                   "evidence_available", "evidence_support", "consolidation_state")


_ASOF = "ret20 ret120 amp5 ma60_slope10 position_all"


@query("features_asof_latest", f"WITH {BARS}, {feature_sql(280)} " + r6(
    """SELECT symbol, trade_date, consolidation_state, ret20, ret120, amp5, ma60_slope10, position_all FROM feat
       QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1""", _ASOF))
def _(spark, sf):
    return features_asof(v.bars(spark, sf)).select("symbol", "trade_date", "consolidation_state", *_ASOF.split())


@query("features_for_registry", f"WITH {BARS}, {feature_sql(280)} " + r6(
    f"""SELECT symbol, trade_date, ret20, ret40, ma20_dist FROM feat WHERE symbol IN
       (SELECT {"concat(CASE s_suppkey % 4 WHEN 0 THEN '600' WHEN 1 THEN '300' WHEN 2 THEN '688' ELSE '920' END, lpad(CAST(s_suppkey AS VARCHAR),3,'0'))"}
        FROM supplier WHERE s_acctbal >= 0)
       QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1""", "ret20 ret40 ma20_dist"))
def _(spark, sf):
    reg = v.master(spark, sf).filter("s_acctbal >= 0")
    return features_for_registry(reg, v.bars(spark, sf)).select("symbol", "trade_date", "ret20", "ret40", "ma20_dist")


@query("limit_up_evidence", f"WITH {RAW}, {LIMIT} " + r6(
    """SELECT symbol, trade_date, limit_up_25, limit_up_count_25, limit_up_last_date, limit_board, limit_verified_days,
       max_daily_pct_25 FROM lim""", "max_daily_pct_25"))
def _(spark, sf):
    return limit_up_evidence(v.raw_bars(spark, sf)).select(
        "symbol", "trade_date", "limit_up_25", "limit_up_count_25", "limit_up_last_date", "limit_board",
        "limit_verified_days", "max_daily_pct_25")


_PLAT = "platform_upper"
_EV = "breakout_volume_ratio retest_volume_ratio hold_amp micro_upper micro_volume_ratio"


@query("compact_platform", f"WITH {BARS}, {BREAK} " + r6(
    "SELECT symbol, trade_date, platform_days, platform_upper FROM brk", _PLAT))
def _(spark, sf):
    return breakout_evidence(v.bars(spark, sf)).select("symbol", "trade_date", "platform_days", "platform_upper")


@query("breakout_events", f"WITH {BARS}, {BREAK} " + r6(
    """SELECT symbol, trade_date, breakout_date, sessions_since_breakout, breakout_volume_ratio, retest_volume_ratio, hold_amp,
       micro_upper, micro_volume_ratio FROM brk""", _EV))
def _(spark, sf):
    return breakout_evidence(v.bars(spark, sf)).select("symbol", "trade_date", "breakout_date", "sessions_since_breakout", *_EV.split())


@query("n_shape", f"WITH {BARS}, {BREAK} SELECT symbol, trade_date, n_shape FROM brk")
def _(spark, sf):
    return breakout_evidence(v.bars(spark, sf)).select("symbol", "trade_date", "n_shape")


@query("breakout_stage", f"""WITH {BARS}, {BREAK} SELECT symbol, trade_date, breakout_stage, breakout_route, breakout_eligible,
  breakout_confirmed, retest_holds, renewed FROM brk""")
def _(spark, sf):
    return breakout_evidence(v.bars(spark, sf)).select(
        "symbol", "trade_date", "breakout_stage", "breakout_route", "breakout_eligible", "breakout_confirmed",
        "retest_holds", "renewed")


# ---- stages ---------------------------------------------------------------------------------------
def _b(x: str) -> str:
    return f"CAST(coalesce({x}, false) AS INT)"


def s1_sql(src: str) -> str:
    return f"""s1 AS (SELECT *, {_b('ret20 >= 0')}*2 + {_b('ma25_dist > 0')}*2 + {_b('amp5 <= 0.18')} + {_b('ret10 <= 0.20')}
   + {_b('ret10 >= -0.12')} + {_b('robust_upper5_dist BETWEEN -0.10 AND 0.06')} AS stage1_score,
  coalesce(latest_close > 0, false) AND coalesce(limit_up_25, false) AND coalesce(ma25_dist > 0, false) AND coalesce(ma25_slope1 > 0, false) AS stage1_pass,
  CASE WHEN ma25_dist IS NULL OR ma25_slope1 IS NULL THEN 'MA25证据不足' WHEN ma25_dist <= 0 THEN '收盘价未站上MA25'
   WHEN ma25_slope1 <= 0 THEN 'MA25未上扬' WHEN amp5 > 0.18 THEN '近5日波动仍偏大' WHEN ret10 > 0.20 THEN '近10日速度偏快'
   WHEN ret20 < 0 THEN '20日方向仍偏弱' ELSE '' END AS stage1_risk FROM {src})"""


def panel_sql(depth: int) -> str:
    return f"""{RAW}, {LIMIT}, {BREAK}, {feature_sql(depth)},
pan AS (SELECT feat.*, limit_up_25, breakout_stage, breakout_eligible, platform_days, n_shape FROM feat
  JOIN lim USING (symbol, trade_date) JOIN brk USING (symbol, trade_date))"""


def audit_sql(score: str, ok: str, out: str, src: str) -> str:
    return f"""{out} AS (SELECT *, CASE WHEN {score} IS NOT NULL THEN CAST(rank() OVER (PARTITION BY trade_date ORDER BY {score} DESC NULLS LAST) AS INT) END AS stage_rank,
  {ok} AS selected, count_if({ok}) OVER (PARTITION BY trade_date) AS selected_n,
  min(CASE WHEN {ok} THEN {score} END) OVER (PARTITION BY trade_date) AS cutoff_score FROM {src})"""


def capped_sql(score: str, ok: str, lo: int, hi: int, src: str) -> str:
    """Soft capacity: cutoff at the lo-th eligible score, ties extended up to hi."""
    return f"""k0 AS (SELECT *, row_number() OVER (PARTITION BY trade_date, {ok} ORDER BY {score} DESC, symbol) AS pos,
  count_if({ok}) OVER (PARTITION BY trade_date) AS tot FROM {src}),
k1 AS (SELECT *, CASE WHEN tot <= {lo} THEN min(CASE WHEN {ok} THEN {score} END) OVER (PARTITION BY trade_date)
   ELSE max(CASE WHEN {ok} AND pos = {lo} THEN {score} END) OVER (PARTITION BY trade_date) END AS cutoff_score FROM k0),
k2 AS (SELECT *, count_if({ok} AND {score} >= cutoff_score) OVER (PARTITION BY trade_date) AS nat FROM k1),
k3 AS (SELECT *, CASE WHEN tot <= {lo} THEN tot ELSE least({hi}, greatest({lo}, nat)) END AS selected_n FROM k2)"""


S1_COLS = "symbol, trade_date, stage1_score, stage1_pass, stage1_risk, stage_rank, selected, selected_n, cutoff_score"


def panel26(spark, sf):
    return metrics_panel(v.raw_bars(spark, sf), 26)


@query("stage1_audit", f"WITH {panel_sql(26)}, {s1_sql('pan')}, {audit_sql('stage1_score', 'stage1_pass', 'a1', 's1')} SELECT {S1_COLS} FROM a1")
def stage1_audit(spark, sf):
    return screen.stage1(panel26(spark, sf)).select(*S1_COLS.split(", "))


@query("rank_and_audit_capacity", f"""WITH {panel_sql(26)}, {s1_sql('pan')}, {capped_sql('stage1_score', 'stage1_pass', 3, 5, 's1')}
  SELECT symbol, trade_date, stage1_score, selected_n, cutoff_score, stage1_pass AND pos <= selected_n AS selected,
  CASE WHEN NOT stage1_pass THEN '未入选：未满足一级粗筛最低资格条件'
   WHEN pos <= selected_n THEN concat('入选：stage1_score=', CAST(stage1_score AS VARCHAR), '；软容量3-5只，本次实际', CAST(selected_n AS VARCHAR), '只')
   ELSE '未入选：满足基础条件，但位于本次软容量边界之外（3-5只）' END AS reason FROM k3""")
def _(spark, sf):
    return screen.stage1(panel26(spark, sf), 3, 5).select(
        "symbol", "trade_date", "stage1_score", "selected_n", "cutoff_score", "selected", "reason")


def s2_sql(src: str) -> str:
    base = "coalesce(amp5 <= 0.18 AND ret10 <= 0.20, false)"
    return f"""s2a AS (SELECT *, {base} AND coalesce(evidence_available >= 2, false) AND coalesce(evidence_support >= 2, false) AS mature,
  coalesce(amp_contraction <= 1, false) AS amp_narrow, coalesce(ret40 >= 0, false) AS trend_alive,
  coalesce(ma20_dist > 0 AND ma30_slope5 > 0, false) AS ma_aid,
  coalesce(robust_upper5_dist BETWEEN -0.02 AND 0.03, false) AS uc, coalesce(robust_upper5_dist BETWEEN -0.05 AND 0.05, false) AS uw,
  coalesce(ret1 BETWEEN 0.02 AND 0.06, false) AS ra FROM {src}),
s2 AS (SELECT *, CAST(mature AS INT)*3 + CAST(amp_narrow AS INT) + CAST(liquidity_contraction AS INT) + CAST(decline_stopped AS INT)
   + CAST(trend_alive AS INT)*3 + CAST(ma_aid AS INT) + CASE WHEN uc THEN 4 WHEN uw THEN 2 ELSE 0 END + CAST(ra AS INT) AS stage2_score,
  mature AND trend_alive AND ma_aid AND platform_days BETWEEN 3 AND 5 AND NOT n_shape AND breakout_eligible AS stage2_pass,
  CASE WHEN evidence_available < 2 THEN '量价/换手整理证据不足' WHEN evidence_support < 2 THEN '振幅、量能、换手或短期趋势尚未形成两类收敛支持'
   WHEN amp5 > 0.18 THEN '短波动仍偏大' WHEN ret10 > 0.20 THEN '10日速度仍偏快，整理可能未完成' WHEN ret40 < 0 THEN '40日趋势偏弱'
   WHEN abs(robust_upper5_dist) > 0.08 THEN '距离短周期稳健上沿较远' ELSE '' END AS stage2_risk FROM s2a)"""


@query("stage2_audit", f"""WITH {panel_sql(120)}, {s2_sql('pan')}, {audit_sql('stage2_score', 'stage2_pass', 'a2', 's2')}
  SELECT symbol, trade_date, mature, stage2_score, stage2_pass, stage2_risk, stage_rank, selected, selected_n, cutoff_score FROM a2""")
def _(spark, sf):
    return screen.stage2(metrics_panel(v.raw_bars(spark, sf), 120)).select(
        "symbol", "trade_date", "mature", "stage2_score", "stage2_pass", "stage2_risk", "stage_rank", "selected",
        "selected_n", "cutoff_score")


def s3_sql(src: str) -> str:
    return f"""s3a AS (SELECT *, coalesce(ret120 >= 0 AND ma120_slope20 >= 0, false) AS long_ok,
  coalesce(position_all < 0.45 AND ret120 < 0 AND ma120_slope20 < 0, false) AS dn,
  CASE WHEN stage2_score IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date, stage2_score IS NULL ORDER BY stage2_score)
    + (count(*) OVER (PARTITION BY trade_date, stage2_score) - 1) / 2.0) / count(stage2_score) OVER (PARTITION BY trade_date) END AS pr FROM {src}),
s3 AS (SELECT *, coalesce(position_all >= 0.65, false) AND long_ok AS ru, CAST(long_ok AS INT)*3
   + CAST(coalesce(position_all >= 0.65, false) AND long_ok AS INT)*2 + CAST(coalesce(ret40 >= 0, false) AS INT) + pr*3 - CAST(dn AS INT)*6 AS stage3_score,
  NOT dn AS stage3_pass,
  CASE WHEN dn THEN '长期下降趋势修复' WHEN coalesce(position_all >= 0.65, false) AND long_ok THEN '右上角/高位趋势' WHEN long_ok THEN '中期上升趋势延续'
   ELSE '中段/待确认' END AS lifecycle,
  CASE WHEN dn THEN '长期下降趋势中的修复/反弹，降级' WHEN ret40 > 0.5 THEN '40日加速较大：仅作趋势成熟风险提示，不单独判尾端'
   WHEN ret120 < 0 THEN '120日趋势偏弱' ELSE '' END AS stage3_risk FROM s3a)"""


@query("stage3_audit", f"WITH {panel_sql(250)}, {s2_sql('pan')}, {s3_sql('s2')} " + r6(
    "SELECT symbol, trade_date, stage3_score, stage3_pass, lifecycle, stage3_risk, pr AS pct_rank FROM s3", "stage3_score pct_rank"))
def _(spark, sf):
    x = screen.stage2_score(metrics_panel(v.raw_bars(spark, sf), 250))
    x = screen.stage3_score(x).withColumn("pct_rank", F.col("stage2_carry") / 3)
    return x.select("symbol", "trade_date", "stage3_score", "stage3_pass", "lifecycle", "stage3_risk", "pct_rank")


FUNNEL = f"""WITH {panel_sql(250)}, {s1_sql('pan')}, p1 AS (SELECT * FROM s1 WHERE stage1_pass), {s2_sql('p1')},
  p2 AS (SELECT * FROM s2 WHERE stage2_pass), {s3_sql('p2')},
  al AS (SELECT *, stage3_pass AND evidence_support >= 3 AS qualified,
    coalesce(stage3_score, -999) + coalesce(stage2_score, 0) - {_b('ret1 > 0.06')}*3 - {_b('ret40 > 0.80')}*2 AS align_score FROM s3),
  al2 AS (SELECT *, CASE WHEN qualified THEN CAST(row_number() OVER (PARTITION BY trade_date, qualified
     ORDER BY round(align_score,9) DESC, round(stage3_score,9) DESC, symbol) AS INT) END AS align_rank FROM al),
  al3 AS (SELECT *, CASE WHEN NOT stage3_pass THEN 'MID_TERM_TREND_WEAK' WHEN evidence_support < 3 THEN 'STRUCTURE_NOT_MATURE'
     WHEN align_rank <= 50 THEN 'QUALIFIED' ELSE 'LOWER_PRIORITY' END AS outcome FROM al2)"""


@query("screening_funnel", FUNNEL + " " + r6(
    "SELECT symbol, trade_date, stage2_score, stage3_score, lifecycle, align_score, align_rank, outcome FROM al3", "stage3_score align_score"))
def _(spark, sf):
    return funnel(v.raw_bars(spark, sf))["aligned"].select(
        "symbol", "trade_date", "stage2_score", "stage3_score", "lifecycle", "align_score", "align_rank", "outcome")


@query("align_outcome_counts", FUNNEL + " SELECT trade_date, outcome, count(*) AS n FROM al3 GROUP BY 1, 2")
def _(spark, sf):
    return screen.outcome_counts(funnel(v.raw_bars(spark, sf))["aligned"], ("trade_date",))


@query("funnel_sizes", FUNNEL + """ SELECT 'audit1' AS stage, count(*) AS seen, count_if(stage1_pass) AS selected FROM s1
  UNION ALL SELECT 'audit2', count(*), count_if(stage2_pass) FROM s2 UNION ALL SELECT 'audit3', count(*), count_if(stage3_pass) FROM s3
  UNION ALL SELECT 'aligned', count(*), count_if(outcome = 'QUALIFIED') FROM al3""")
def _(spark, sf):
    return funnel_counts(funnel(v.raw_bars(spark, sf)))


@query("revision_replay", FUNNEL.replace("FROM bars)", "FROM bars)", 1).replace(feature_sql(250), feature_sql(260)) +
       " SELECT symbol, trade_date, stage2_score, outcome FROM al3")
def _(spark, sf):
    stages = revision_replay(v.raw_bars(spark, sf), v.master(spark, sf))
    return stages["aligned"].select("symbol", "trade_date", "stage2_score", "outcome")


@query("stage2_evidence_attach", f"WITH {panel_sql(250)}, {s2_sql('pan')} " + r6(
    "SELECT symbol, trade_date, ret120, mature, stage2_score, amp_contraction FROM s2", "ret120 amp_contraction"))
def _(spark, sf):
    p = metrics_panel(v.raw_bars(spark, sf), 250)
    return screen.attach_stage2_evidence(p, screen.stage2(p)).select(
        "symbol", "trade_date", "ret120", "mature", "stage2_score", "amp_contraction")


def v4_sql(n: int, cap: int) -> str:
    return (f"v AS (SELECT *, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY sc DESC, symbol) AS INT) AS stage_rank, "
            f"row_number() OVER (PARTITION BY trade_date, ok ORDER BY sc DESC, symbol) AS pos FROM g) "
            f"SELECT symbol, trade_date, sc AS stage{n}_score, stage_rank, ok AND pos <= {cap} AS selected FROM v")


@query("stage1_v4", f"""WITH {panel_sql(26)}, g AS (SELECT *, {_b('ret20 >= 0')}*2 + {_b('ma20_dist >= 0')}*2 + {_b('amp5 <= 0.18')}
  + {_b('ret10 <= 0.20')} + {_b('ret10 >= -0.12')} + {_b('robust_upper5_dist BETWEEN -0.10 AND 0.06')} AS sc,
  coalesce(latest_close > 0, false) AS ok FROM pan), {v4_sql(1, 10)}""")
def _(spark, sf):
    return screen.stage1(panel26(spark, sf), max_n=10, rules=screen.V4).select(
        "symbol", "trade_date", "stage1_score", "stage_rank", "selected")


@query("stage2_v4", f"""WITH {panel_sql(120)}, g AS (SELECT *, {_b('amp5 <= 0.18 AND ret10 <= 0.20')}*3 + {_b('ret40 >= 0')}*3
  + {_b('ma20_dist > 0 AND ma30_slope5 > 0')} + CASE WHEN robust_upper5_dist BETWEEN -0.02 AND 0.03 THEN 4
  WHEN robust_upper5_dist BETWEEN -0.05 AND 0.05 THEN 2 ELSE 0 END + {_b('ret1 BETWEEN 0.02 AND 0.06')} AS sc,
  coalesce(amp5 <= 0.18 AND ret10 <= 0.20 AND ret40 >= 0, false) AS ok FROM pan), {v4_sql(2, 30)}""")
def _(spark, sf):
    return screen.stage2(metrics_panel(v.raw_bars(spark, sf), 120), rules=screen.V4).select(
        "symbol", "trade_date", "stage2_score", "stage_rank", "selected")


S1V4 = f"""{_b('ret20 >= 0')}*2 + {_b('ma20_dist >= 0')}*2 + {_b('amp5 <= 0.18')} + {_b('ret10 <= 0.20')} + {_b('ret10 >= -0.12')} + {_b('robust_upper5_dist BETWEEN -0.10 AND 0.06')}"""
S2V4 = f"""{_b('amp5 <= 0.18 AND ret10 <= 0.20')}*3 + {_b('ret40 >= 0')}*3 + {_b('ma20_dist > 0 AND ma30_slope5 > 0')} + CASE WHEN robust_upper5_dist BETWEEN -0.02 AND 0.03 THEN 4
  WHEN robust_upper5_dist BETWEEN -0.05 AND 0.05 THEN 2 ELSE 0 END + {_b('ret1 BETWEEN 0.02 AND 0.06')}"""
OK2V4 = "coalesce(amp5 <= 0.18 AND ret10 <= 0.20 AND ret40 >= 0, false)"


@query("stage3_v4", f"WITH {panel_sql(250)}, s2 AS (SELECT *, {S2V4} AS stage2_score FROM pan), {s3_sql('s2')}, g AS (SELECT *, stage3_score AS sc, stage3_pass AS ok FROM s3), "
       + v4_sql(3, 10).replace("SELECT symbol, trade_date, sc AS stage3_score", "SELECT symbol, trade_date, lifecycle, round(sc, 6) + 0.0 AS stage3_score"))
def _(spark, sf):
    x = screen.stage2_score(metrics_panel(v.raw_bars(spark, sf), 250), screen.V4)
    return screen.stage3(materialise(x, "stage2-v4"), max_n=10, rules=screen.V4).select("symbol", "trade_date", "lifecycle", "stage3_score", "stage_rank", "selected")


def _cap(n: int, src: str, score: str, ok: str, cap: int) -> str:
    """Rows of `src` that pass and are among the first `cap` of their date."""
    return f"""e{n} AS (SELECT *, {score} AS stage{n}_score, {ok} AS ok{n} FROM {src}),
 p{n} AS (SELECT * EXCLUDE (pos{n}) FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, ok{n} ORDER BY stage{n}_score DESC, symbol) AS pos{n} FROM e{n}) WHERE ok{n} AND pos{n} <= {cap})"""


@query("funnel_v4", f"WITH {panel_sql(250)}, {_cap(1, 'pan', S1V4, 'coalesce(latest_close > 0, false)', 60)}, {_cap(2, 'p1', S2V4, OK2V4, 30)}, {s3_sql('p2')}, g AS (SELECT *, stage3_score AS sc, stage3_pass AS ok FROM s3), "
       + v4_sql(3, 10).replace("SELECT symbol, trade_date, sc AS stage3_score", "SELECT symbol, trade_date, stage1_score, stage2_score, lifecycle, round(sc, 6) + 0.0 AS stage3_score"))
def _(spark, sf):
    rules = replace(screen.V4, caps=(60, 30, 10))
    return funnel(v.raw_bars(spark, sf), rules=rules)["audit3"].select("symbol", "trade_date", "stage1_score", "stage2_score", "lifecycle", "stage3_score", "stage_rank", "selected")


@query("revision_missing", f"WITH {BARS} SELECT concat({SYM.replace('l_suppkey', 's_suppkey')}, 'X') AS symbol FROM supplier WHERE s_suppkey % 10 = 0 UNION SELECT {SYM.replace('l_suppkey', 's_suppkey')} FROM supplier WHERE {SYM.replace('l_suppkey', 's_suppkey')} NOT IN (SELECT symbol FROM bars)")
def _(spark, sf):
    m = v.master(spark, sf)
    active = m.select("symbol").unionByName(m.filter("s_suppkey % 10 = 0").select(F.concat("symbol", F.lit("X")).alias("symbol")))
    return without_history(v.raw_bars(spark, sf), active)
