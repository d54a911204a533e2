"""Bar history maintenance and the trade calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scalars import BUSINESS_TZ, business_clock, first_match, flag
from barloom.functions.scale import last_at_or_before, newest_row
from barloom.sources.ingest import last_n_bars

KEEP, DEEP = 280, 250


def seed_history(copies: DataFrame) -> DataFrame:
    """Among stored copies of a symbol keep the one with most rows (lowest copy number on ties)."""
    n = copies.groupBy("symbol", "copy").agg(F.count(F.lit(1)).alias("_n"))
    best = n.groupBy("symbol").agg(F.max_by("copy", F.struct("_n", -F.col("copy"))).alias("copy"))
    return copies.join(best, ["symbol", "copy"], "left_semi")


def append_closed_day(hist: DataFrame, spot: DataFrame, pool: DataFrame, day: str, previous_day: str,
                      guard: float = 0.015, order: str | None = None, listing: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(history with the day appended where allowed, outcome per symbol). Where a symbol is listed several times, `listing` names the column of pool and spot
    that tells its listings apart: each has its own quote and outcome, and the first one that may append gives the symbol's bar.

    spot: symbol, close, open, high, low, previous, volume, amount, turnover; of a symbol's rows the last in `order`
    counts (a column of spot, such as its capture time), so that a date stays unique per symbol.
    """
    last_row = F.max_by(F.struct(*spot.columns), F.struct(*([order] if order else []), *spot.columns))
    keys = ["symbol", *([listing] if listing else [])]
    spot = spot.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(last_row.alias("_r")).select("_r.*")
    d, p = F.lit(day).cast("date"), F.lit(previous_day).cast("date")
    last = hist.groupBy("symbol").agg(F.max("trade_date").alias("_latest"), F.max_by("close", "trade_date").alias("_close"))
    x = pool.select(*keys).distinct().join(last, "symbol", "left").join(spot.withColumn("_q", F.lit(True)), keys, "left")
    far = F.col("_close").isNull() | F.col("previous").isNull() | (F.col("previous") <= 0) | (
        F.abs(F.col("_close") / F.col("previous") - 1) > guard)
    x = x.withColumn("outcome", first_match([
        (F.col("_latest").isNull(), "missing_cache"), (F.col("_latest") >= d, "already_current"),
        ((F.col("_latest") != p) | F.col("_q").isNull(), "needs_history"), (F.coalesce(far, F.lit(True)), "corporate_action"),
        (~flag(F.col("close") > 0), "needs_history")], "appended"))
    pos = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.col("close"))
    appended = x.filter("outcome = 'appended'")
    new = (newest_row(appended, ["symbol"], [F.col(listing)], newest=False) if listing else appended).select(
        "symbol", d.alias("trade_date"), pos("open").alias("open"), pos("high").alias("high"), pos("low").alias("low"), "close",
        *[F.col(c) for c in ("volume", "amount", "turnover") if c in spot.columns],
        pos("open").alias("raw_open"), pos("high").alias("raw_high"), pos("low").alias("raw_low"), F.col("close").alias("raw_close"),
        F.lit(1.0).alias("adj_factor"))
    return last_n_bars(hist.unionByName(new, allowMissingColumns=True), KEEP), x.select(*keys, "outcome")


def append_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def merge_increment(hist: DataFrame, inc: DataFrame, need: int = 260) -> DataFrame:
    """Newest row wins per date; the last max(280, need + 20) dates stay."""
    u = hist.withColumn("version", F.lit(0)).unionByName(inc.withColumn("version", F.lit(1)), allowMissingColumns=True)
    return last_n_bars(u, max(KEEP, need + 20), "version").drop("version")


def history_manifest(hist: DataFrame, pool: DataFrame, asof: str) -> DataFrame:
    a = hist.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    x = pool.select("symbol").distinct().join(a, "symbol", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    cur = flag(F.col("last_date") >= F.lit(asof).cast("date"))
    return x.withColumns({"is_current": cur, "deep_ready": F.col("rows") >= DEEP, "needs_refetch": ~cur})


def refresh_plan(pool: DataFrame, manifest: DataFrame, need: int = 26) -> DataFrame:
    ready = manifest.filter(F.col("is_current") & (F.col("rows") >= need)).select("symbol")
    return pool.join(ready, "symbol", "left_anti")


def defer_stale(pool: DataFrame, manifest: DataFrame, need: int = 26) -> tuple[DataFrame, DataFrame]:
    """(ready members, QA rows of deferred members)."""
    ready = manifest.filter(F.col("is_current") & (F.col("rows") >= need)).select("symbol")
    late = pool.join(ready, "symbol", "left_anti").select("symbol", F.lit("延期").alias("status"))
    return pool.join(ready, "symbol", "left_semi"), late


# ---- calendar (bounded: one row per trade date) ---------------------------------------------------------
def calendar(dates: DataFrame) -> DataFrame:
    """trade_date with previous and next trade date and its position."""
    w = W.partitionBy(F.lit(0)).orderBy("trade_date")
    d = dates.select("trade_date").distinct()
    return d.select("trade_date", F.lag("trade_date").over(w).alias("previous_date"), F.lead("trade_date").over(w).alias("next_date"),
                    F.row_number().over(w).alias("position"))


def is_weekday(d) -> Column:
    return F.weekday(d) < 5


def _asof(days: DataFrame, cal: DataFrame, forward: bool, name: str) -> DataFrame:
    """Nearest trade date for distinct days, spread by year so that no task holds them all."""
    c = cal.select("trade_date").withColumn("_hit", F.col("trade_date"))
    # Neighbouring years are copied so that the nearest date is always in the day's own group.
    c = c.withColumn("_y", F.explode(F.sequence(F.year("trade_date") - 1, F.year("trade_date") + 1)))
    q = days.select("day").distinct().withColumn("_y", F.year("day"))
    f = last_at_or_before(c, q, "_y", "trade_date", "day", ["_hit"], forward)
    return days.join(f.select("day", F.col("_hit").alias(name)), "day", "left")


def trade_day_status(days: DataFrame, cal: DataFrame) -> DataFrame:
    """is_trade_day, previous trade date (before the day) and next one (from the day on); weekday rule without a table hit."""
    z = _asof(days, cal, True, "target_date")
    prev = days.select(F.date_sub("day", 1).alias("day")).distinct()
    p = _asof(prev, cal, False, "previous_date").select(F.date_add("day", 1).alias("day"), "previous_date")
    z = z.join(p, "day", "left")
    return z.withColumns({"is_trade_day": flag(F.col("target_date") == F.col("day")), "weekday_rule": is_weekday("day")})


def expected_latest(ts: str, is_trade_day: str, previous: str, close_hour: int = 15, tz: str = BUSINESS_TZ) -> Column:
    """Last completed trade date at a moment: today only after the close of a trade day, by the business clock."""
    t = business_clock(ts, tz)
    return F.when(F.col(is_trade_day) & (F.hour(t) >= close_hour), F.to_date(t)).otherwise(F.col(previous))


def target_trade_date(days: DataFrame, cal: DataFrame) -> DataFrame:
    """The day if it is a trade date, else the next one; past the table the next weekday."""
    z = _asof(days, cal, True, "_t")
    wd = F.weekday("day")
    roll = F.when(wd == 5, F.date_add("day", 2)).when(wd == 6, F.date_add("day", 1)).otherwise(F.col("day"))
    return z.withColumn("target_date", F.coalesce("_t", roll)).drop("_t")


def business_date(ts, delayed: Column | None = None, tz: str = BUSINESS_TZ) -> Column:
    """Before 06:00 belongs to the previous date; a delayed delivery before 20:00 as well (business clock)."""
    t = business_clock(ts, tz)
    early = F.hour(t) < 6
    if delayed is not None:
        early = early | (delayed & (F.hour(t) < 20))
    return F.when(early, F.date_sub(F.to_date(t), 1)).otherwise(F.to_date(t))
