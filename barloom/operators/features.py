"""Per-symbol features at every trade date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scalars import as_int, first_match, flag, safe_div
from barloom.operators.panel import (MA_SPANS, RETURN_SPANS, base, blocks, by_symbol, deep_extremes, deep_offsets,
                                     highest, lag_col, lowest, mean, second_of, shifted, without_temps)

# Consolidation state labels.
STATE_UNKNOWN, STATE_FULL, STATE_PART, STATE_RAW = "证据不足", "收敛较充分", "部分收敛/待确认", "结构未成熟"

SLOPES = {"ma5_slope3": (5, 3, 8), "ma10_slope3": (10, 3, 13), "ma25_slope1": (25, 1, 26),
          "ma30_slope5": (30, 5, 35), "ma60_slope10": (60, 10, 70), "ma120_slope20": (120, 20, 140)}


def near_columns(x: DataFrame, depth: int) -> DataFrame:
    """Features that need offsets up to 14 only."""
    rows = F.least(F.col("rn"), F.lit(depth))
    c = F.col("close")

    def at(n: int) -> Column:
        return lag_col("c", n) if n <= 14 else F.col(f"_far{n}")

    def amp(hi: str, lo: str, need: int) -> Column:
        return F.when((F.col("_rows") >= need) & (F.col(lo) > 0), (F.col(hi) - F.col(lo)) / F.col(lo))

    x = x.withColumns({
        "_rows": rows, "latest_close": c,
        "low5": lowest("l", 0, 4), "low10": lowest("l", 0, 9),
        "_h5": highest("h", 0, 4), "_h15": highest("h", 5, 14), "_l15": lowest("l", 5, 14),
        "vol5": mean("v", 0, 4), "turnover5": mean("t", 0, 4),
        "_v15": mean("v", 5, 14), "_t15": mean("t", 5, 14), "_second": second_of("h", 1, 5)})
    return x.withColumns({
        **{f"ret{n}": F.when(F.col("_rows") > n, safe_div(c, at(n)) - 1) for n in RETURN_SPANS},
        "amp5": amp("_h5", "low5", 5), "amp_prev10": amp("_h15", "_l15", 15),
        "vol_prev10": F.when(F.col("_rows") >= 15, F.col("_v15")),
        "turnover_prev10": F.when(F.col("_rows") >= 15, F.col("_t15")),
        "robust_upper5": F.when(F.col("_rows") >= 6, F.col("_second"))})


def far_columns(x: DataFrame, depth: int) -> DataFrame:
    """Slopes (third pass) and everything that depends on averages and extremes."""
    w = by_symbol()
    old = {f"_old_{k}": F.lag(f"ma{n}", back).over(w) for k, (n, back, _) in SLOPES.items()}
    x = x.withColumns({**old, **deep_offsets(depth)})
    slope = {k: F.when((F.col("_rows") >= need) & (F.col("_rows") >= n + back),
                       safe_div(F.col(f"ma{n}"), F.col(f"_old_{k}")) - 1) for k, (n, back, need) in SLOPES.items()}
    c = F.col("close")
    x = x.filter("_priced").withColumns({**slope, **deep_extremes(depth)})
    x = x.withColumns({
        "amp_contraction": F.when(F.col("amp_prev10") > 0, F.col("amp5") / F.col("amp_prev10")),
        "vol_contraction": F.when(F.col("vol_prev10") > 0, F.col("vol5") / F.col("vol_prev10")),
        "turnover_contraction": F.when(F.col("turnover_prev10") > 0, F.col("turnover5") / F.col("turnover_prev10")),
        "decline_stopped": flag((F.col("ma5_slope3") >= -0.01) & (F.col("ma10_slope3") >= -0.01)),
        "dist_high20": safe_div(c, F.col("_h20")) - 1,
        "dist_high_all": safe_div(c, F.col("_hall")) - 1,
        "position_all": F.when(F.col("_hall") > F.col("_lall"), (c - F.col("_lall")) / (F.col("_hall") - F.col("_lall"))),
        "low5_dist": F.when(F.col("low5") > 0, c / F.col("low5") - 1),
        "low10_dist": F.when(F.col("low10") > 0, c / F.col("low10") - 1),
        "ma20_dist": safe_div(c, F.col("ma20")) - 1,
        "ma25_dist": safe_div(c, F.col("ma25")) - 1,
        "robust_upper5_dist": F.when(F.col("robust_upper5") > 0, c / F.col("robust_upper5") - 1)})
    return contraction_votes(x)


def contraction_votes(x: DataFrame) -> DataFrame:
    """Three evidences: range, liquidity (volume and turnover count once), short decline stopped."""
    vol, tur = F.col("vol_contraction"), F.col("turnover_contraction")
    seen = vol.isNotNull().cast("int") + tur.isNotNull().cast("int")
    votes = as_int(vol <= 1.0) + as_int(tur <= 1.0)
    x = x.withColumn("liquidity_contraction", (seen > 0) & (votes >= F.floor((seen + 1) / 2)))
    slopes = (F.col("ma5_slope3").isNotNull() & F.col("ma10_slope3").isNotNull()).cast("int")
    x = x.withColumns({
        "evidence_available": F.col("amp_contraction").isNotNull().cast("int") + (seen > 0).cast("int") + slopes,
        "evidence_support": (as_int(F.col("amp_contraction") <= 1.0) + F.col("liquidity_contraction").cast("int")
                             + F.col("decline_stopped").cast("int"))})
    sup = F.col("evidence_support")
    return x.withColumn("consolidation_state", first_match(
        [(F.col("evidence_available") < 2, STATE_UNKNOWN),
         ((sup >= 3) & F.col("decline_stopped"), STATE_FULL),
         (sup >= 2, STATE_PART)], STATE_RAW))


def features(bars: DataFrame, depth: int = 280) -> DataFrame:
    """All features per (symbol, trade_date), as if `depth` (>= 26) bars ending at that date were supplied."""
    return without_temps(far_columns(shifted(near_columns(blocks(base(bars)), depth), depth), depth))


def last_bars(bars: DataFrame, depth: int, asof: str | None = None) -> DataFrame:
    """The last `depth` bars per symbol on or before `asof`."""
    b = bars if asof is None else bars.filter(F.col("trade_date") <= F.lit(asof).cast("date"))
    newest = F.row_number().over(W.partitionBy("symbol").orderBy(F.col("trade_date").desc()))
    return b.withColumn("_back", newest).filter(F.col("_back") <= depth)


def features_asof(bars: DataFrame, asof: str | None = None, depth: int = 280) -> DataFrame:
    """Latest row per symbol on or before `asof`, computed from its last `depth` bars only."""
    x = features(last_bars(bars, depth, asof).withColumnRenamed("_back", "back"), depth)
    return x.filter("back = 1").drop("back")


def features_for_registry(registry: DataFrame, bars: DataFrame, asof: str | None = None, depth: int = 280) -> DataFrame:
    """Features of registry members that have stored history, from the full stored depth."""
    return features_asof(bars.join(registry.select("symbol"), "symbol", "left_semi"), asof, depth)


__all__ = ["MA_SPANS", "RETURN_SPANS", "features", "features_asof", "features_for_registry", "last_bars"]
