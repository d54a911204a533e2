"""Registry of named queries: a Spark callable and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(tune(spark), sf_dir))
        run.__name__, run.group = name, fn.__module__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at six decimals (and never -0.0), so that two engines can be compared value by value."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append((F.round(c, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c)
    return df.select(*cols)


def r6(sql: str, cols: str) -> str:
    """The same rounding in SQL for the named columns."""
    rep = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in cols.split())
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS r6_"


SYM = ("concat(CASE l_suppkey % 4 WHEN 0 THEN '600' WHEN 1 THEN '300' WHEN 2 THEN '688' ELSE '920' END, "
       "lpad(CAST(l_suppkey AS VARCHAR),3,'0'))")

BARS = f"""bars AS (SELECT {SYM} AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
  round(10 + (min(l_extendedprice/l_quantity)+max(l_extendedprice/l_quantity))/2/20000, 2) AS open,
  round(10 + max(l_extendedprice/l_quantity)/20000, 2) AS high,
  round(10 + min(l_extendedprice/l_quantity)/20000, 2) AS low,
  round(10 + avg(l_extendedprice/l_quantity)/20000, 2) AS close,
  sum(l_quantity) AS volume, round(avg(l_discount)*100, 4) AS turnover FROM lineitem GROUP BY 1,2)"""

RAW = BARS + """, raw_bars AS (SELECT * EXCLUDE (rn_, pc_, r_),
  CASE WHEN rn_ % 40 = 0 THEN CAST(round(CAST(pc_ AS DECIMAL(18,6))*r_, 2) AS DOUBLE) ELSE close END AS raw_close
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) rn_,
    lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) pc_,
    CASE left(symbol,3) WHEN '600' THEN CAST(1.10 AS DECIMAL(4,2)) WHEN '920' THEN CAST(1.30 AS DECIMAL(4,2))
      ELSE CAST(1.20 AS DECIMAL(4,2)) END r_ FROM bars))"""


def frame(k: str, a: int, b: int) -> str:
    """Aggregate over the bars a..b before the current one."""
    return f"({k}) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {b} PRECEDING AND {a} PRECEDING)" if a else \
        f"({k}) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {b} PRECEDING AND CURRENT ROW)"


W = "(PARTITION BY symbol ORDER BY trade_date)"


def ma(n: int) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN count(close) {w} = {n} THEN "
            f"CAST(sum(CAST(close AS DECIMAL(18,6))) {w} AS DOUBLE) / {n} END AS ma{n}")


def feature_sql(depth: int, src: str = "bars") -> str:
    """CTE `feat`: every feature per symbol and date with plain window aggregates."""
    def agg(f, c, a, b):
        return f"{f}{frame(c, a, b)}"
    spans = (1, 5, 10, 20, 40, 60, 120)
    mas = (5, 10, 20, 25, 30, 60, 120)
    l1 = ", ".join([f"lag(close,{n}) OVER {W} AS c{n}" for n in spans] + [ma(n) for n in mas])
    l2 = ", ".join(f"CASE WHEN nr > {n} THEN close/nullif(c{n},0) - 1 END AS ret{n}" for n in spans)

    def slope(name, n, back, need):
        ok = f"nr >= {max(need, n + back)}"
        return f"CASE WHEN {ok} THEN ma{n}/nullif(lag(ma{n},{back}) OVER {W},0) - 1 END AS {name}"
    drop = [f"ma{n}" for n in mas if n > depth]
    nul = "".join(f", NULL::DOUBLE AS {d}" for d in drop)
    ex = f"EXCLUDE ({', '.join(drop)})" if drop else ""
    return f"""f1 AS (SELECT *, row_number() OVER {W} AS rn, least(row_number() OVER {W}, {depth}) AS nr, {l1},
  {agg('max', 'high', 0, 4)} AS h5, {agg('min', 'low', 0, 4)} AS low5, {agg('max', 'high', 5, 14)} AS h15,
  {agg('min', 'low', 5, 14)} AS l15, {agg('avg', 'volume', 0, 4)} AS vol5, {agg('avg', 'turnover', 0, 4)} AS turnover5,
  {agg('avg', 'volume', 5, 14)} AS v15, {agg('avg', 'turnover', 5, 14)} AS t15, {agg('max', 'high', 0, 19)} AS h20,
  {agg('max', 'high', 0, depth - 1)} AS hall, {agg('min', 'low', 0, depth - 1)} AS lall,
  {agg('min', 'low', 0, 9)} AS low10, {agg('list', 'high', 1, 5)} AS highs FROM {src}),
f1b AS (SELECT * {ex} {nul} FROM f1),
f2 AS (SELECT *, close AS latest_close, {l2},
  CASE WHEN nr >= 5 AND low5 > 0 THEN (h5-low5)/low5 END AS amp5,
  CASE WHEN nr >= 15 AND l15 > 0 THEN (h15-l15)/l15 END AS amp_prev10,
  CASE WHEN nr >= 15 THEN v15 END AS vol_prev10, CASE WHEN nr >= 15 THEN t15 END AS turnover_prev10,
  CASE WHEN nr >= 6 THEN list_sort(highs, 'DESC')[2] END AS robust_upper5,
  {slope('ma5_slope3', 5, 3, 8)}, {slope('ma10_slope3', 10, 3, 13)}, {slope('ma25_slope1', 25, 1, 26)},
  {slope('ma30_slope5', 30, 5, 35)}, {slope('ma60_slope10', 60, 10, 70)}, {slope('ma120_slope20', 120, 20, 140)} FROM f1b),
f3 AS (SELECT *, CASE WHEN amp_prev10 > 0 THEN amp5/amp_prev10 END AS amp_contraction,
  CASE WHEN vol_prev10 > 0 THEN vol5/vol_prev10 END AS vol_contraction,
  CASE WHEN turnover_prev10 > 0 THEN turnover5/turnover_prev10 END AS turnover_contraction,
  coalesce(ma5_slope3 >= -0.01 AND ma10_slope3 >= -0.01, false) AS decline_stopped,
  close/nullif(h20,0) - 1 AS dist_high20, close/nullif(hall,0) - 1 AS dist_high_all,
  CASE WHEN hall > lall THEN (close-lall)/(hall-lall) END AS position_all,
  CASE WHEN low5 > 0 THEN close/low5 - 1 END AS low5_dist, CASE WHEN low10 > 0 THEN close/low10 - 1 END AS low10_dist,
  close/nullif(ma20,0) - 1 AS ma20_dist, close/nullif(ma25,0) - 1 AS ma25_dist,
  CASE WHEN robust_upper5 > 0 THEN close/robust_upper5 - 1 END AS robust_upper5_dist FROM f2),
f4 AS (SELECT *, CAST(vol_contraction IS NOT NULL AS INT) + CAST(turnover_contraction IS NOT NULL AS INT) AS nliq,
  CAST(coalesce(vol_contraction <= 1, false) AS INT) + CAST(coalesce(turnover_contraction <= 1, false) AS INT) AS vliq FROM f3),
f5 AS (SELECT *, nliq > 0 AND vliq >= (nliq + 1) // 2 AS liquidity_contraction FROM f4),
f6 AS (SELECT *, CAST(amp_contraction IS NOT NULL AS INT) + CAST(nliq > 0 AS INT)
    + CAST(ma5_slope3 IS NOT NULL AND ma10_slope3 IS NOT NULL AS INT) AS evidence_available,
  CAST(coalesce(amp_contraction <= 1, false) AS INT) + CAST(liquidity_contraction AS INT)
    + CAST(decline_stopped AS INT) AS evidence_support FROM f5),
feat AS (SELECT *, CASE WHEN evidence_available < 2 THEN '证据不足' WHEN evidence_support >= 3 AND decline_stopped THEN '收敛较充分'
  WHEN evidence_support >= 2 THEN '部分收敛/待确认' ELSE '结构未成熟' END AS consolidation_state FROM f6)"""


LIMIT = """lim0 AS (SELECT *, lag(raw_close) OVER (PARTITION BY symbol ORDER BY trade_date) AS pc,
  CASE WHEN symbol LIKE '300%' OR symbol LIKE '301%' OR symbol LIKE '688%' OR symbol LIKE '689%' THEN 20.0
    WHEN symbol LIKE '4%' OR symbol LIKE '8%' OR symbol LIKE '920%' THEN 30.0 ELSE 10.0 END::DOUBLE AS lp,
  CASE WHEN symbol LIKE '300%' OR symbol LIKE '301%' THEN '创业板20%' WHEN symbol LIKE '688%' OR symbol LIKE '689%' THEN '科创板20%'
    WHEN symbol LIKE '4%' OR symbol LIKE '8%' OR symbol LIKE '920%' THEN '北交所30%' ELSE '沪深主板10%' END AS limit_board FROM raw_bars),
lim1 AS (SELECT *, CASE WHEN pc > 0 THEN (raw_close/pc - 1)*100 END AS pct,
  abs(CAST(raw_close AS DECIMAL(18,6)) - round(CAST(pc AS DECIMAL(18,6)) * CAST(1 + lp/100 AS DECIMAL(4,2)), 2)) AS gap FROM lim0),
lim2 AS (SELECT *, coalesce(gap <= 0.005 AND pct BETWEEN lp - 0.25 AND lp + 0.80, false) AS hit FROM lim1),
lim AS (SELECT *, CAST(count_if(hit) OVER w AS INT) AS limit_up_count_25, max(CASE WHEN hit THEN trade_date END) OVER w AS limit_up_last_date,
  CAST(count(pct) OVER w AS INT) AS limit_verified_days, max(pct) OVER w AS max_daily_pct_25,
  count_if(hit) OVER w > 0 AS limit_up_25 FROM lim2
  WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 24 PRECEDING AND CURRENT ROW))"""


def _brk() -> str:
    def agg(f, c, a, b):
        return f"{f}{frame(c, a, b)}"
    l1 = ", ".join(
        [f"{agg('max', 'high', 0, d - 1)} AS hi{d}, {agg('min', 'low', 0, d - 1)} AS lo{d}, {agg('avg', 'volume', 0, d - 1)} AS mv{d}, "
         f"{agg('avg', 'volume', d, 2 * d - 1)} AS pv{d}, list_sort({agg('list', 'high', 0, d - 1)}, 'DESC')[2] AS up{d}" for d in (3, 4, 5)]
        + [f"{agg('min', 'low', 0, k - 1)} AS al{k}, {agg('max', 'high', 0, k - 1)} AS ah{k}, {agg('min', 'close', 0, k - 1)} AS ac{k}, "
           f"{agg('avg', 'volume', 0, k - 1)} AS av{k}, lag(low,{k - 1}) OVER {W} AS fl{k}" for k in (1, 2, 3, 4)]
        + [f"{agg('max', 'high', 1, k - 1)} AS mh{k}, {agg('min', 'low', 1, k - 1)} AS ml{k}, {agg('avg', 'volume', 1, k - 1)} AS mm{k}"
           for k in (2, 3, 4)])
    cw = " ".join(f"WHEN rn >= {d} AND lo{d} > 0 AND (hi{d}-lo{d})/lo{d} <= 0.10 AND (pv{d} IS NULL OR mv{d} <= pv{d}*1.05) THEN {d}"
                  for d in (5, 4, 3))

    def by_days(p):
        return "CASE cwd WHEN 3 THEN {0}3 WHEN 4 THEN {0}4 WHEN 5 THEN {0}5 END".format(p)
    evl = ", ".join(f"lag(ev,{k}) OVER {W} AS ev{k}" for k in (1, 2, 3, 4))

    def by_k(p, ks):
        return "CASE k " + " ".join(f"WHEN {i} THEN {p}{i}" for i in ks) + " END"
    return f"""b1 AS (SELECT *, row_number() OVER {W} AS rn, lag(close) OVER {W} AS pc, {agg('list', 'close', 0, 9)} AS c10, {l1} FROM bars),
b2 AS (SELECT *, CASE {cw} END AS cwd FROM b1),
b3 AS (SELECT *, {by_days('up')} AS cwu, {by_days('mv')} AS cwm FROM b2),
b4 AS (SELECT *, lag(cwd) OVER {W} AS pd, lag(cwu) OVER {W} AS pu, lag(cwm) OVER {W} AS pm FROM b3),
b5 AS (SELECT *, CASE WHEN rn >= 6 AND pu > 0 AND pm > 0 AND pc <= pu AND close > pu AND volume/pm >= 1.2
  THEN {{'d': pd, 'u': pu, 'v': volume, 'r': volume/pm, 't': trade_date}} END AS ev FROM b4),
b6 AS (SELECT *, {evl} FROM b5),
b7 AS (SELECT *, CASE WHEN ev IS NOT NULL THEN 0 WHEN ev1 IS NOT NULL THEN 1 WHEN ev2 IS NOT NULL THEN 2 WHEN ev3 IS NOT NULL THEN 3
  WHEN ev4 IS NOT NULL THEN 4 END AS k, coalesce(ev, ev1, ev2, ev3, ev4) AS e FROM b6),
b8 AS (SELECT *, {by_k('al', (1, 2, 3, 4))} AS al, {by_k('ah', (1, 2, 3, 4))} AS ah, {by_k('ac', (1, 2, 3, 4))} AS ac,
  {by_k('av', (1, 2, 3, 4))} AS av, {by_k('fl', (1, 2, 3, 4))} AS fl, {by_k('mh', (3, 4))} AS mh, {by_k('ml', (3, 4))} AS ml,
  {by_k('mm', (2, 3, 4))} AS mm, e.u AS u, e.v AS evol, close/pc - 1 AS r1,
  CASE WHEN rn >= 10 THEN list_position(c10[1:7], list_max(c10[1:7])) END AS pk FROM b7),
b9 AS (SELECT *, CASE WHEN rn >= 10 THEN list_min(c10[pk+1:10]) END AS tr FROM b8),
b10 AS (SELECT *, CASE WHEN rn >= 10 THEN coalesce(list_position(c10[pk+1:10], tr) + pk < 10 AND tr/c10[pk] - 1 <= -0.08
   AND close/tr - 1 >= 0.05, false) ELSE false END AS nsh FROM b9),
b11 AS (SELECT *, coalesce(k >= 1 AND al >= u*0.98, false) AS holds, CASE WHEN k >= 1 AND evol > 0 THEN av/evol END AS vr,
  coalesce(k >= 1 AND close >= u AND r1 > 0 AND r1 <= 0.03, false) AS renew,
  CASE WHEN al > 0 THEN (ah-al)/al END AS hamp, CASE WHEN ml > 0 THEN (mh-ml)/ml END AS mamp,
  CASE WHEN mm > 0 THEN volume/mm END AS mratio FROM b10),
b12 AS (SELECT *, CASE WHEN rn < 10 OR k IS NULL OR nsh OR NOT holds THEN ''
  WHEN k BETWEEN 3 AND 4 AND mamp <= 0.05 AND mm <= evol*0.8 AND ml >= u*0.98 AND close > mh AND mratio BETWEEN 1.05 AND 1.80
    AND close/mh - 1 <= 0.03 THEN 'MICRO_PLATFORM_REBREAK'
  WHEN k BETWEEN 2 AND 4 AND vr <= 0.8 AND ac >= u AND low >= fl*0.98 AND hamp <= 0.06 AND renew AND close/u - 1 <= 0.05
    THEN 'ABOVE_PLATFORM_TIGHT_HOLD'
  WHEN k BETWEEN 1 AND 3 AND vr <= 0.8 AND renew THEN 'RETEST_RENEWED_STRENGTH' ELSE '' END AS breakout_route FROM b11),
brk AS (SELECT *, CASE WHEN rn < 10 THEN 'INELIGIBLE' WHEN breakout_route <> '' THEN 'EFFECTIVE_BREAKOUT_CONFIRMED'
    WHEN k = 0 THEN 'BREAKOUT_AWAIT_RETEST' WHEN k IS NOT NULL THEN 'RETEST_STABILIZING'
    WHEN cwd IS NOT NULL AND NOT nsh THEN 'READY_FOR_BREAKOUT' ELSE 'INELIGIBLE' END AS breakout_stage,
  rn >= 10 AND k IS NOT NULL AND NOT nsh AS breakout_eligible, breakout_route <> '' AS breakout_confirmed,
  CAST(CASE WHEN rn < 10 THEN 0 WHEN k IS NOT NULL THEN e.d ELSE coalesce(cwd, 0) END AS INT) AS platform_days,
  CASE WHEN rn >= 10 THEN CASE WHEN k IS NOT NULL THEN u ELSE cwu END END AS platform_upper,
  CASE WHEN rn >= 10 THEN e.t END AS breakout_date, CASE WHEN rn >= 10 THEN k END AS sessions_since_breakout,
  CASE WHEN rn >= 10 THEN e.r END AS breakout_volume_ratio, CASE WHEN rn >= 10 THEN vr END AS retest_volume_ratio,
  rn >= 10 AND k IS NOT NULL AND holds AS retest_holds, rn >= 10 AND k IS NOT NULL AND renew AS renewed, nsh AS n_shape,
  CASE WHEN rn >= 10 AND k IS NOT NULL THEN hamp END AS hold_amp, CASE WHEN rn >= 10 AND k IS NOT NULL THEN mh END AS micro_upper,
  CASE WHEN rn >= 10 AND k IS NOT NULL THEN mratio END AS micro_volume_ratio FROM b12)"""


BREAK = _brk()
