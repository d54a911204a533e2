"""Market breadth, limit pools, history and context. Daily tables are partitioned by metric, never sorted whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scalars import flag
from barloom.functions.scale import newest_row, with_scalars
from barloom.operators.panel import by_symbol

# Pool kinds and their component labels, regimes.
POOL_KINDS = {"up": "涨停", "down": "跌停", "broken": "炸板", "previous": "昨日涨停", "strong": "强势"}
ACTIVE, NORMAL = "较好/活跃", "一般或偏弱"
CONTEXT_COLUMNS = ("up_ratio", "down_ratio", "net_up", "limit_up", "limit_down", "amount")


def breadth_counts(spot: DataFrame, by=("trade_date",)) -> DataFrame:
    p = F.col("pct")
    return spot.groupBy(*by).agg(F.count("pct").alias("valid"), F.count_if(p > 0).alias("up"), F.count_if(p < 0).alias("down"),
                                 F.count_if(p == 0).alias("flat"))


def best_snapshot(candidates: DataFrame, order: list[str], by=("trade_date",)) -> DataFrame:
    """Rows of the source with most valid percentages, then most rows, then first in `order`, per date. A source without a valid
    percentage is no candidate; nor is one that `order` leaves out."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    n = candidates.groupBy(*by, "source").agg(F.count("pct").alias("_v"), F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_p", place).filter((F.col("_v") > 0) & (F.col("_p") > 0))
    best = n.groupBy(*by).agg(F.max_by("source", F.struct("_v", "_n", -F.col("_p"))).alias("source"))
    return candidates.join(best, [*by, "source"], "left_semi")


def breadth_row(spot: DataFrame, pools: DataFrame, activity: DataFrame | None = None) -> DataFrame:
    """One wide row per date. pools: trade_date, kind, symbol, streak, pct. activity: trade_date and fallback counts
    act_up, act_down, act_flat, act_limit_up, act_limit_down."""
    p, k = F.col("pct"), F.col("kind")
    s = spot.groupBy("trade_date").agg(
        F.count("pct").alias("valid"), F.count_if(p > 0).alias("up"), F.count_if(p < 0).alias("down"),
        F.count_if(p == 0).alias("flat"), F.count_if(p >= 5).alias("up5"), F.count_if(p <= -5).alias("down5"),
        F.sum("amount").alias("amount"))
    q = pools.groupBy("trade_date").agg(
        *[F.nullif(F.count_if(k == n), F.lit(0)).alias(f"_{n}") for n in POOL_KINDS],
        F.max(F.when(k == "up", F.col("streak"))).alias("max_streak"),
        F.avg(F.when(k == "previous", p)).alias("previous_premium"),
        F.avg(F.when((k == "previous") & p.isNotNull(), (p > 0).cast("double"))).alias("previous_positive_rate"),
        F.avg(F.when(k == "broken", p)).alias("broken_mean_pct"))
    x = s.join(q, "trade_date", "left")
    if activity is not None:
        x = x.join(activity, "trade_date", "left")
    else:
        x = x.withColumns({c: F.lit(None).cast("long") for c in ("act_up", "act_down", "act_flat", "act_limit_up", "act_limit_down")})
    bad_spot = F.coalesce(F.col("valid"), F.lit(0)) == 0
    x = x.withColumns({"breadth_degraded": bad_spot, "limits_degraded": F.col("_up").isNull() | F.col("_down").isNull()})
    for c in ("up", "down", "flat"):
        x = x.withColumn(c, F.when(F.col("breadth_degraded"), F.col(f"act_{c}")).otherwise(F.col(c)))
    x = x.withColumn("valid", F.when(F.col("breadth_degraded"), F.col("up") + F.col("down") + F.col("flat")).otherwise(F.col("valid")))
    x = x.withColumns({"limit_up": F.coalesce("_up", "act_limit_up"), "limit_down": F.coalesce("_down", "act_limit_down"),
                       "broken": F.col("_broken"), "previous": F.col("_previous"), "strong": F.col("_strong")})
    x = x.withColumn("touched", F.col("limit_up") + F.col("broken"))
    n = F.nullif(F.col("valid"), F.lit(0))
    x = x.withColumns({"up_ratio": F.col("up") / n, "down_ratio": F.col("down") / n, "net_up": F.col("up") - F.col("down"),
                       "seal_rate": F.col("limit_up") / F.nullif(F.col("touched"), F.lit(0)),
                       "shadow_ready": F.col("broken").isNotNull() & F.col("previous").isNotNull() & F.col("strong").isNotNull()})
    return x.drop(*[f"_{c}" for c in POOL_KINDS])


def cross_source_diff(breadth: DataFrame) -> DataFrame:
    """Counts that differ between the formal and the fallback source, as one QA row per date."""
    pairs = [("上涨", "up", "act_up"), ("下跌", "down", "act_down"), ("平盘", "flat", "act_flat"),
             ("涨停", "limit_up", "act_limit_up"), ("跌停", "limit_down", "act_limit_down")]
    parts = F.array_compact(F.array(*[
        F.when(F.col(a) != F.col(b), F.concat(F.lit(f"{t}:"), F.col(a).cast("string"), F.lit("/"), F.col(b).cast("string")))
        for t, a, b in pairs]))
    return breadth.select("trade_date", F.when(F.size(parts) > 0, "警告").otherwise("一致").alias("status"),
                          F.array_join(parts, " | ").alias("diff"))


def market_history(old: DataFrame, new: DataFrame, days: int = 180) -> DataFrame:
    """Last row wins per date; the newest `days` dates are kept (the date list is bounded by the calendar)."""
    u = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    z = newest_row(u, ["trade_date"], [F.col("_v")]).drop("_v")
    keep = z.select("trade_date").orderBy(F.col("trade_date").desc()).limit(days)
    return z.join(keep, "trade_date", "left_semi")


def market_context(history: DataFrame, spans=(5, 20, 60), columns=CONTEXT_COLUMNS) -> DataFrame:
    """Long rows (trade_date, metric): value, change, change rate, and mean and percentile over recent known values."""
    long = history.select("trade_date", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["trade_date"], list(columns), "metric", "value").filter(F.col("value").isNotNull())
    w = W.partitionBy("metric").orderBy("trade_date")
    x = long.withColumn("_prev", F.lag("value").over(w)).withColumns({
        "change": F.col("value") - F.col("_prev"),
        "change_rate": F.col("value") / F.nullif(F.col("_prev"), F.lit(0.0)) - 1})
    for n in spans:
        frame = w.rowsBetween(-(n - 1), 0)
        x = x.withColumn(f"_l{n}", F.collect_list("value").over(frame)).withColumn(f"_a{n}", F.avg("value").over(frame))
        enough = F.size(f"_l{n}") >= min(3, n)
        share = F.size(F.filter(f"_l{n}", lambda v: v <= F.col("value"))) / F.size(f"_l{n}")
        x = x.withColumns({f"mean_{n}": F.when(enough, F.col(f"_a{n}")), f"pct_rank_{n}": F.when(enough, share)})
    return x.drop("_prev", *[f"_l{n}" for n in spans], *[f"_a{n}" for n in spans])


def pool_components(pools: DataFrame) -> DataFrame:
    """Long (trade_date, component, symbol) rows of the limit pools."""
    label = F.create_map(*[F.lit(x) for kv in POOL_KINDS.items() for x in kv])
    return pools.select("trade_date", label[F.col("kind")].alias("component"), "symbol").distinct()


def index_summary(index_bars: DataFrame) -> DataFrame:
    """Latest close and 5/20/60-bar returns per index."""
    w = by_symbol()
    x = index_bars.select("symbol", "trade_date", "close").withColumns(
        {f"ret{n}": F.col("close") / F.nullif(F.lag("close", n).over(w), F.lit(0.0)) - 1 for n in (5, 20, 60)})
    return newest_row(x, ["symbol"], [F.col("trade_date")])


def pool_policy(breadth: DataFrame, context: DataFrame, min_up: float = 0.60, min_amount: float = 0.05) -> DataFrame:
    """Pool range by breadth and turnover: 5..10 when active, else 0..5."""
    a = context.filter(F.col("metric") == "amount").select("trade_date", F.col("change_rate").alias("amount_change"))
    x = breadth.select("trade_date", F.coalesce("up_ratio", F.col("up") / F.nullif(F.col("valid"), F.lit(0))).alias("up_ratio"))
    x = x.join(a, "trade_date", "left")
    act = flag((F.col("up_ratio") >= min_up) & (F.col("amount_change") >= min_amount))
    return x.withColumns({"regime": F.when(act, ACTIVE).otherwise(NORMAL), "minimum": F.when(act, 5).otherwise(0),
                          "maximum": F.when(act, 10).otherwise(5)})


def close_audit(tail: DataFrame, close: DataFrame, fields: list[str]) -> DataFrame:
    """Field by field close minus tail per date, unknown as 0."""
    t = tail.select("trade_date", *[F.col(c).alias(f"_t_{c}") for c in fields])
    z = close.join(t, "trade_date")
    return z.select("trade_date", *[(F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"_t_{c}"), F.lit(0))).alias(f"delta_{c}")
                                    for c in fields])


def change_counts(changes: DataFrame, audit: DataFrame, asof: str) -> DataFrame:
    c = changes.agg(F.count_if(F.col("change") == "新增").alias("added"), F.count_if(F.col("change") == "重新激活").alias("reactivated"))
    a = audit.agg(F.count_if((F.col("status") == "已淘汰") & (F.col("eliminated_on") == F.lit(asof).cast("date"))).alias("eliminated"),
                  F.count_if(F.col("status") == "冷却观察").alias("cooling"))
    return with_scalars(c, a)


def with_pct(prices: DataFrame, price: str = "price") -> DataFrame:
    """Percentage change against the previous stored row of the symbol."""
    prev: Column = F.lag(price).over(by_symbol())
    return prices.withColumn("pct", (F.col(price) / F.nullif(prev, F.lit(0.0)) - 1) * 100)
