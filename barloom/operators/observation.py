"""Rolling observation pool: sources of the last trade dates, exclusions, order and cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import flag, norm_code
from barloom.functions.scale import attach, newest_row, top_k, with_scalars

EXIT_WORDS = "已退出|已卖出|止盈退出|止损退出"  # fixed values
NEVER_HELD = "未成交|取消"


def latest_sources(meta: DataFrame, calendar: DataFrame, today: str, days: int = 3) -> DataFrame:
    """Newest valid source per one of the last `days` trade dates before today.

    meta: path, generated, target, generated_at, status. A source targets the next source date, the newest one
    targets today; without a newest source the result is empty. calendar: trade_date.
    """
    t = F.lit(today).cast("date")
    dates = top_k(calendar.filter(F.col("trade_date") < t).select("trade_date").distinct(), [], [F.col("trade_date").desc()],
                  days, ["trade_date"], "source_rank")
    nxt = dates.select((F.col("source_rank") + 1).alias("source_rank"), F.col("trade_date").alias("_want"))
    dates = dates.join(nxt, "source_rank", "left").withColumn("_want", F.coalesce("_want", t))
    z = meta.join(dates, meta.generated == dates.trade_date).filter(
        (F.col("target") == F.col("_want")) & (F.coalesce("status", F.lit("valid")) == "valid"))
    best = newest_row(z.select("generated", "source_rank", "path", "generated_at"), ["generated"], [F.col("generated_at"), F.col("path")])
    ok = best.agg(F.max(F.col("source_rank") == 1).alias("_ok"))
    return with_scalars(best, ok).filter(flag(F.col("_ok"))).drop("_ok")


def exclude_active(pool: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pool without held or un-exited symbols, the excluded symbols)."""
    a = active.select("symbol").distinct()
    return pool.join(a, "symbol", "left_anti"), pool.join(a, "symbol", "left_semi").select("symbol").distinct()


def active_trades(positions: DataFrame | None, recos: DataFrame) -> DataFrame:
    """Symbols that stay locked: those held by the ledger. Only without a ledger (None), recommended trades that are not described
    as exited, not filled or cancelled. recos: symbol, decision, data_status."""
    if positions is not None:
        return positions.filter("qty > 0").select("symbol").distinct()
    gone = F.coalesce(F.col("data_status"), F.lit("")).rlike(f"{EXIT_WORDS}|{NEVER_HELD}")
    trade = flag(F.upper("decision") == "TRADE")
    return recos.filter(trade & ~gone).select(norm_code("symbol").alias("symbol")).filter("symbol <> ''").distinct()


def exit_dates(recos: DataFrame) -> DataFrame:
    """Latest known date of closed recommendations per symbol."""
    closed = flag(F.col("trade_status") == "已清仓") | flag(F.col("data_status").rlike(EXIT_WORDS))
    last = F.greatest("actual_sell_date", "exit_tracking_date", "updated_on", "reco_date")
    return recos.filter(closed).groupBy("symbol").agg(F.max(last).alias("exit_date"))


def exclude_stale_closed(pool: DataFrame, exits: DataFrame) -> DataFrame:
    """Drop symbols whose newest source is not after their exit, or where a date is unknown."""
    z = pool.join(exits.withColumn("_x", F.lit(True)), "symbol", "left")
    stale = F.col("_x").isNotNull() & (F.col("exit_date").isNull() | F.col("newest_source").isNull()
                                       | (F.col("newest_source") <= F.col("exit_date")))
    return z.filter(~flag(stale)).drop("_x", "exit_date")


def pool_union(sources: DataFrame) -> DataFrame:
    """One row per symbol from its newest source; dates, count and ranks of all its sources (at most a few dates)."""
    g = sources.groupBy("symbol").agg(
        F.min_by("priority", "source_rank").alias("priority"), F.min("source_rank").alias("newest_rank"),
        F.sort_array(F.collect_set("source_date"), asc=False).alias("source_dates"),
        F.max("source_date").alias("newest_source"), F.min("source_date").alias("oldest_source"))
    return g.withColumn("source_count", F.size("source_dates"))


def rolling_pool(sources: DataFrame, cap: int = 10, exclude: DataFrame | None = None, exits: DataFrame | None = None) -> DataFrame:
    """Union, exclusions, order (newest rank, count desc, priority nulls last, symbol), cap; `kept` marks the pool.

    sources: symbol, source_date, source_rank, priority. Symbols beyond the cap stay in the result as trimmed.
    """
    p = pool_union(sources)
    if exclude is not None:
        p = exclude_active(p, exclude)[0]
    if exits is not None:
        p = exclude_stale_closed(p, exits)
    order = [F.col("newest_rank"), F.col("source_count").desc(), F.col("priority").asc_nulls_last(), F.col("symbol")]
    top = top_k(p.select("symbol", "newest_rank", "source_count", "priority"), [], order, cap, ["symbol"], "place")
    z = attach(p, top, ["symbol"], ["place"])
    return z.withColumn("kept", F.col("place").isNotNull())


def scan_universe(pool: DataFrame, holdings: DataFrame) -> DataFrame:
    return pool.select("symbol").unionByName(holdings.select("symbol")).distinct()
