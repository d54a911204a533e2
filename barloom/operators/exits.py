"""Holding exits: structure break first, trailing profit second; missing data is never read as hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scalars import first_match, flag
from barloom.functions.scale import last_at_or_before, top_k
from barloom.session import materialise

# Reasons by action.
INTRADAY_REASONS = {
    "DATA_ERROR": "实时价、两根5分钟收盘或结构止损缺失，禁止把缺失结果解释为继续持有",
    "HOLD_T1": "当日新增持仓不可卖；仅提示结构风险",
    "EXIT_ALL": "连续两根5分钟收盘低于结构止损，结构破位优先全部退出",
    "REDUCE_50": "最高浮盈达到8%后，从最高收盘价回撤达到5%，先减仓一半锁利",
    "HOLD": "未确认结构破位，且盈利回撤止盈条件未同时满足"}
CLOSE_REASONS = {
    "DATA_ERROR": "完整日线、持仓成本或原结构止损缺失，禁止默认继续持有",
    "EXIT_NEXT_SESSION": "收盘价已低于当前结构止损，若仍有持仓，下一交易时段优先退出并由14:45规则继续确认",
    "REDUCE_NEXT_SESSION": "最高浮盈已达8%且收盘回撤达到5%，下一交易时段优先减仓并继续执行盘中规则",
    "HOLD": "收盘结构仍有效；继续持有并使用更新后的结构止损和回撤止盈参考"}


def partial_qty(sellable) -> Column:
    s = F.col(sellable) if isinstance(sellable, str) else sellable
    half = F.greatest(F.lit(100), F.floor(s * 0.5 / 100) * 100)
    return F.when(s <= 0, 0).when(s < 200, s).otherwise(half).cast("long")


def _reason(action: Column, table: dict[str, str]) -> Column:
    return first_match([(action == k, v) for k, v in table.items()], "")


def high_since(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Highest positive close from each start date on: a backward running maximum over distinct start dates."""
    w = W.partitionBy("symbol").orderBy(F.col("trade_date").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    peak = bars.withColumn("high_close", F.max(F.when(F.col("close") > 0, F.col("close"))).over(w))
    probes = positions.select("symbol", F.coalesce("start_date", F.lit("1900-01-01").cast("date")).alias("start_date"))
    return last_at_or_before(peak, probes, "symbol", "trade_date", "start_date", ["high_close"], forward=True)


def exit_intraday(positions: DataFrame, snapshot: DataFrame, minute: DataFrame, bars: DataFrame,
                  stops: DataFrame) -> DataFrame:
    """One row per open position with its action. snapshot: symbol, price; minute: symbol, ts, close."""
    snap = snapshot.filter(F.col("price").isNotNull())
    if "ts" in snap.columns:
        snap = snap.groupBy("symbol").agg(F.max_by("price", "ts").alias("price"))
    mins = minute.filter(F.col("close").isNotNull())
    peak = mins.groupBy("symbol").agg(F.max(F.when(F.col("close") > 0, F.col("close"))).alias("_minute_high"))
    two = top_k(mins.select("symbol", "ts", "close"), ["symbol"], [F.col("ts").desc()], 2, ["ts"])
    two = two.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n2"), F.max("close").alias("_max2"))
    priced = bars.filter(F.col("close").isNotNull()).select("symbol", "trade_date", "close")
    ten = (priced.withColumn("_k", F.row_number().over(W.partitionBy("symbol").orderBy(F.col("trade_date").desc())))
           .filter("_k <= 10").groupBy("symbol").agg(F.avg("close").alias("_ma"), F.count("close").alias("_n10")))
    ten = ten.select("symbol", F.when(F.col("_n10") >= 5, F.col("_ma")).otherwise(0.0).alias("_ma10"))
    p = positions.withColumn("start_date", F.coalesce("start_date", F.lit("1900-01-01").cast("date")))
    x = (p.join(high_since(positions, priced), ["symbol", "start_date"], "left").join(snap, "symbol", "left")
         .join(peak, "symbol", "left").join(two, "symbol", "left").join(ten, "symbol", "left")
         .join(stops.select("symbol", F.col("stop").alias("_saved")), "symbol", "left"))
    live = flag(F.col("price") > 0)
    x = x.withColumn("high_close", F.greatest("high_close", "_minute_high", F.when(live, F.col("price"))))
    x = x.withColumns({
        "_gain": F.when(F.col("avg_cost") > 0, F.col("high_close") / F.col("avg_cost") - 1),
        "_draw": F.when(F.col("high_close") > 0, (F.col("high_close") - F.col("price")) / F.col("high_close"))})
    x = x.withColumn("_stop", F.greatest(F.coalesce("_saved", F.lit(0.0)),
                                         F.when(F.col("_gain") >= 0.05, F.coalesce("_ma10", F.lit(0.0))).otherwise(0.0)))
    complete = live & (F.col("_stop") > 0) & flag(F.col("_n2") == 2)
    broken = flag((F.col("_stop") > 0) & (F.col("_n2") == 2) & (F.col("_max2") < F.col("_stop"))
                  & (F.col("price") < F.col("_stop")))
    trailing = flag(F.col("_gain") >= 0.08)
    sell = F.coalesce("sellable", F.lit(0))
    action = first_match([(~complete, "DATA_ERROR"), (sell <= 0, "HOLD_T1"), (broken, "EXIT_ALL"),
                          (trailing & flag(F.col("_draw") >= 0.05), "REDUCE_50")], "HOLD")
    x = x.withColumn("action", action)
    return x.select(
        "account", "symbol", "qty", "sellable", F.round("avg_cost", 4).alias("avg_cost"), F.round("price", 4).alias("price"),
        F.round("high_close", 4).alias("high_close"), F.round(F.col("_gain") * 100, 2).alias("max_gain_pct"),
        F.round(F.col("_draw") * 100, 2).alias("drawdown_pct"),
        F.when(F.col("_stop") > 0, F.round("_stop", 4)).alias("stop"), broken.alias("structure_broken"),
        trailing.alias("trailing_active"), "action",
        F.when(F.col("action") == "EXIT_ALL", sell).when(F.col("action") == "REDUCE_50", partial_qty(sell))
        .otherwise(0).cast("long").alias("action_qty"), _reason(F.col("action"), INTRADAY_REASONS).alias("reason"))


#: Bars of a block in the search for the first passage.
BLOCK = 64
FULL, LEAST = 10, 5


def close_index(bars: DataFrame) -> DataFrame:
    """Per bar with a close: its number rn, the closes from it on (up to nine), and the highest close and highest ten-bar average from it on. Both
    are running maxima from the newest bar back. Stored, since four lookups read it."""
    w = W.partitionBy("symbol").orderBy("trade_date")
    down = W.partitionBy("symbol").orderBy(F.col("trade_date").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    b = bars.filter(F.col("close").isNotNull()).select("symbol", "trade_date", "close")
    b = b.withColumns({"rn": F.row_number().over(w), "_ma": F.avg("close").over(w.rowsBetween(1 - FULL, 0)),
                       "head": F.array("close", *[F.lead("close", i).over(w) for i in range(1, FULL - 1)])})
    b = b.withColumns({"high_after": F.max("close").over(down), "ma_after": F.max(F.when(F.col("rn") >= FULL, F.col("_ma"))).over(down)})
    return materialise(b.drop("_ma"), "close-index")


def first_passage(entries: DataFrame, index: DataFrame, hit: Callable[[Column], Column]) -> DataFrame:
    """entries (symbol, rn and what `hit` reads) with `passage`: the number of the first bar from rn on whose close fulfils `hit`, a rule that
    holds above some price. The entry's own block is looked through, then the maxima of the later blocks, then the
    first block that has a hit: three equi joins of one row each, whatever lies between entry and passage."""
    blocks = (index.groupBy("symbol", F.floor((F.col("rn") - 1) / BLOCK).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("rn", "close"))).alias("closes"), F.max("close").alias("high")))
    tops = blocks.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("block", "high"))).alias("tops"))
    at = lambda own, closes: blocks.select("symbol", F.col("block").alias(own), F.col("closes").alias(closes))
    z = entries.withColumn("_own", F.floor((F.col("rn") - 1) / BLOCK))
    z = z.join(at("_own", "_closes"), ["symbol", "_own"], "left").join(tops, "symbol", "left")
    z = z.withColumn("_here", F.get(F.filter("_closes", lambda x: (x["rn"] >= F.col("rn")) & hit(x["close"])), F.lit(0))["rn"])
    later = F.get(F.filter("tops", lambda x: (x["block"] > F.col("_own")) & hit(x["high"])), F.lit(0))["block"]
    z = z.withColumn("_later", F.when(F.col("_here").isNull(), later)).join(at("_later", "_further"), ["symbol", "_later"], "left")
    there = F.get(F.filter("_further", lambda x: hit(x["close"])), F.lit(0))["rn"]
    return z.withColumn("passage", F.coalesce("_here", there)).drop("_own", "_closes", "tops", "_here", "_later", "_further")


def exit_after_close(positions: DataFrame, bars: DataFrame, stops: DataFrame) -> DataFrame:
    """Review from completed daily bars; a stop is only ever raised.

    A position looks up its first bar, the bar at which its gain first reached 5 % (`first_passage`), and the highest ten-bar average from
    there on. Averages of the first nine bars have fewer terms and are put together from the entry bar's closes. No position meets its bars one by one.
    """
    key = ["account", "symbol"]
    index = close_index(bars)
    p = positions.select(*key, "qty", "avg_cost", F.coalesce("start_date", F.lit("1900-01-01").cast("date")).alias("start_date"))
    start = last_at_or_before(index, p, "symbol", "trade_date", "start_date", ["rn", "head", "high_after"], forward=True)
    newest = index.groupBy("symbol").agg(F.max("trade_date").alias("_date"), F.max_by("close", "trade_date").alias("_close"))
    z = p.join(start, ["symbol", "start_date"], "left").join(newest, "symbol", "left")
    z = first_passage(z, index, lambda c: flag(F.try_divide(c, F.col("avg_cost")) - 1 >= 0.05))
    z = z.withColumn("_full", F.greatest(F.col("passage"), F.col("rn") + FULL - 1))
    z = z.withColumn("_full", F.when(F.col("passage").isNotNull(), F.col("_full")))
    z = z.join(index.select("symbol", F.col("rn").alias("_full"), F.col("ma_after").alias("_ma_after")), ["symbol", "_full"], "left")

    def early(k: int) -> Column:
        """Average of the first k closes, where the passage has happened by then."""
        total = F.get("head", F.lit(0))
        for i in range(1, k):
            total = total + F.get("head", F.lit(i))
        return F.when(F.col("rn") + k - 1 >= F.col("passage"), total / k)

    here = F.col("rn").isNotNull()
    x = z.select(*key, "qty", "avg_cost", F.when(here, F.col("_date")).alias("data_date"), F.when(here, F.col("_close")).alias("_last"),
                 F.col("high_after").alias("_high"), F.greatest("_ma_after", *[early(k) for k in range(LEAST, FULL)]).alias("_raised"))
    x = x.join(stops.select("symbol", F.col("stop").alias("_saved")), "symbol", "left")
    ok = flag((F.col("avg_cost") > 0) & (F.col("_saved") > 0)) & F.col("_last").isNotNull()
    x = x.withColumns({"_ok": ok, "_stop": F.greatest(F.col("_saved"), F.coalesce("_raised", F.lit(0.0))),
                       "_gain": F.try_divide("_high", "avg_cost") - 1})
    x = x.withColumns({"_trail": F.when(flag(F.col("_gain") >= 0.08), F.col("_high") * 0.95),
                       "_draw": (F.col("_high") - F.col("_last")) / F.col("_high")})
    x = x.withColumn("action", first_match([(~F.col("_ok"), "DATA_ERROR"), (F.col("_last") < F.col("_stop"), "EXIT_NEXT_SESSION"),
                                            (F.col("_last") <= F.col("_trail"), "REDUCE_NEXT_SESSION")], "HOLD"))

    def when_ok(c: Column) -> Column:
        return F.when(F.col("_ok"), c)
    return x.select(
        *key, "qty", F.when(F.col("avg_cost") > 0, F.round("avg_cost", 4)).alias("avg_cost"),
        when_ok(F.col("data_date")).alias("data_date"), when_ok(F.round("_last", 4)).alias("latest_close"),
        when_ok(F.round("_high", 4)).alias("high_close"), when_ok(F.round(F.col("_gain") * 100, 2)).alias("max_gain_pct"),
        when_ok(F.round(F.col("_draw") * 100, 2)).alias("drawdown_pct"),
        F.when(F.col("_saved") > 0, F.round("_saved", 4)).alias("saved_stop"), when_ok(F.round("_stop", 4)).alias("stop"),
        when_ok(F.col("_stop") > F.col("_saved") + 1e-9).alias("stop_raised"),
        when_ok(F.round(F.col("avg_cost") * 1.08, 4)).alias("activation_price"),
        when_ok(F.round("_trail", 4)).alias("trailing_trigger"), "action",
        _reason(F.col("action"), CLOSE_REASONS).alias("reason"))


def exit_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
