"""The shared window passes under features and evidence.

Bars are unique per (symbol, trade_date), so a symbol's group is bounded by the trading calendar however
many raw rows it had. Everything rests on one exchange on symbol and one sort on date, in three passes:

1. `base`      offsets 1..14 of the bar columns and a few long offsets of close;
2. `shifted`   offsets of running totals and ten-bar extremes, from which averages and 50-bar extremes are
               put together: a dozen offset reads per row instead of some 800 frame updates;
3. callers     offsets of the resulting averages, 50-bar extremes and events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scale import spread

BAR = {"c": "close", "h": "high", "l": "low", "v": "volume", "t": "turnover"}
NEAR = 14
RETURN_SPANS = (1, 5, 10, 20, 40, 60, 120)
MA_SPANS = (5, 10, 20, 25, 30, 60, 120)


def by_symbol():
    return W.partitionBy("symbol").orderBy("trade_date")


def base(bars: DataFrame) -> DataFrame:
    b = bars
    for c in ("volume", "turnover"):
        if c not in b.columns:
            b = b.withColumn(c, F.lit(None).cast("double"))
    w = by_symbol()
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    lags = {f"_{k}{i}": F.lag(c, i).over(w) for i in range(1, NEAR + 1) for k, c in BAR.items()}
    lags |= {f"_far{n}": F.lag("close", n).over(w) for n in RETURN_SPANS if n > NEAR}
    if "raw_close" in b.columns:
        lags["_raw1"] = F.lag("raw_close").over(w)
    x = spread(b, "symbol").withColumns({
        "rn": F.row_number().over(w), **lags,
        "_tot": F.sum(F.round(F.col("close") * 1e6).cast("long")).over(upto),
        "_cnt": F.count("close").over(upto)})
    x = x.withColumns({f"_{k}0": F.col(c) for k, c in BAR.items()})
    return x


def lag_col(k: str, i: int) -> Column:
    return F.col(f"_{k}{i}")


def highest(k: str, a: int, b: int) -> Column:
    """Largest of offsets a..b; NULLs are skipped."""
    cols = [lag_col(k, i) for i in range(a, b + 1)]
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def lowest(k: str, a: int, b: int) -> Column:
    cols = [lag_col(k, i) for i in range(a, b + 1)]
    return cols[0] if len(cols) == 1 else F.least(*cols)


def mean(k: str, a: int, b: int) -> Column:
    """NULL-skipping mean of offsets a..b."""
    cols = [lag_col(k, i) for i in range(a, b + 1)]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return total / F.nullif(n, F.lit(0))


def second_of(k: str, a: int, b: int) -> Column:
    """Second largest of offsets a..b, NULL when fewer than two values exist."""
    s = F.sort_array(F.array_compact(F.array(*[lag_col(k, i) for i in range(a, b + 1)])), asc=False)
    return F.get(s, 1)


def blocks(x: DataFrame) -> DataFrame:
    """Row-level inputs of the second pass."""
    return x.withColumns({"_hi10": highest("h", 0, 9), "_lo10": lowest("l", 0, 9)})


def shifted(x: DataFrame, depth: int) -> DataFrame:
    """Moving averages from running totals, and extremes of the last 50 bars.

    A total over n bars is the difference of two running totals. These are exact integers (micro-units of
    price), so an average does not depend on the order of additions and ties compare as ties.
    """
    w = by_symbol()
    spans = sorted({n for n in MA_SPANS if n <= depth} | {depth})
    old = {f"_{k}{n}": F.lag(f"_{k}", n, 0).over(w) for n in spans for k in ("tot", "cnt")}
    mids = _cover(10, min(depth, 50))
    ext = {f"_{k}10_{o}": F.lag(f"_{k}10", o).over(w) for o in mids for k in ("hi", "lo")}
    x = x.withColumns({**old, **ext})
    mas = {f"ma{n}": F.when((F.col("_cnt") - F.col(f"_cnt{n}") == n) & (F.col("rn") >= n),
                            (F.col("_tot") - F.col(f"_tot{n}")) / 1e6 / n) if n <= depth
           else F.lit(None).cast("double") for n in MA_SPANS}
    return x.withColumns({
        **mas, "_priced": F.col("_cnt") > F.col(f"_cnt{depth}"),
        "_h20": F.greatest(F.col("_hi10"), F.col("_hi10_10")),
        "_hi50": F.greatest(F.col("_hi10"), F.col("_hi10_10"), *[F.col(f"_hi10_{o}") for o in mids]),
        "_lo50": F.least(F.col("_lo10"), F.col("_lo10_10"), *[F.col(f"_lo10_{o}") for o in mids])})


def _cover(block: int, length: int) -> list[int]:
    """Offsets at which blocks of this size cover the last `length` rows (extremes may overlap)."""
    return sorted({*range(block, length - block + 1, block), length - block} - {0})


def deep_offsets(depth: int) -> dict[str, Column]:
    """Third-pass offsets of the 50-bar extremes."""
    w = by_symbol()
    return {f"_{k}50_{o}": F.lag(f"_{k}50", o).over(w)
            for o in (_cover(50, depth) if depth > 50 else []) for k in ("hi", "lo")}


def deep_extremes(depth: int) -> dict[str, Column]:
    at = _cover(50, depth) if depth > 50 else []
    hi, lo = F.col("_hi50"), F.col("_lo50")
    return {"_hall": F.greatest(hi, *[F.col(f"_hi50_{o}") for o in at]) if at else hi,
            "_lall": F.least(lo, *[F.col(f"_lo50_{o}") for o in at]) if at else lo}


def without_temps(x: DataFrame) -> DataFrame:
    return x.drop(*[k for k in x.columns if k.startswith("_")])
