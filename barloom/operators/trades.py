"""Historical trade study: locate trades on bars, measure before, during and after, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scalars import first_match, flag, safe_div, to_double
from barloom.functions.scale import exact_median, last_at_or_before
from barloom.operators.panel import by_symbol, spread
from barloom.session import materialise

# Match states, location states, buckets.
MATCHED, UNMATCHED = "当前名称/规范别名匹配", "未匹配"
OK, UNVERIFIED, NO_RANGE, BAD_ORDER = "成功", "未核验", "日期范围不足", "日期顺序异常"
BUCKETS = ((2, "1-2天"), (5, "3-5天"), (10, "6-10天"), (20, "11-20天"))
BUCKET_LONG, BUCKET_UNKNOWN = "20天以上", "未知"
METRICS = ("pre5_pct", "pre20_pct", "pre_volume_ratio", "buy_vs_high20_pct", "mfe_pct", "mae_pct", "post5_pct", "post10_pct")


def study_key(name) -> Column:
    c = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
    return F.replace(F.replace(F.replace(F.trim(c), F.lit(" "), F.lit("")), F.lit("-U"), F.lit("")), F.lit("A"), F.lit("Ａ"))


def load_trades(df: DataFrame) -> DataFrame:
    """Typed trade table; rows without an account are dropped."""
    out = df.filter(F.col("account").isNotNull())
    for c in ("open_date", "close_date"):
        out = out.withColumn(c, F.col(c).try_cast("date"))
    for c in ("pnl", "pnl_ratio", "buy_price", "sell_price", "holding_days", "fee"):
        if c in out.columns:
            out = out.withColumn(c, to_double(c))
    return out


def attach_codes(trades: DataFrame, master: DataFrame) -> DataFrame:
    """Code by display-name key; the last master row of a key wins."""
    m = master.select(study_key("name").alias("_k"), "symbol").groupBy("_k").agg(F.max("symbol").alias("symbol"))
    z = trades.drop("symbol").withColumn("_k", study_key("name")).join(m, "_k", "left").drop("_k")
    return z.withColumn("match_status", F.when(F.col("symbol").isNotNull(), MATCHED).otherwise(UNMATCHED))


def bar_context(bars: DataFrame) -> DataFrame:
    """Per bar: position, what preceded it and what followed it. Stored: located trades look it up three times."""
    w = by_symbol()
    five, twenty = w.rowsBetween(-5, -1), w.rowsBetween(-20, -1)
    x = spread(bars.select("symbol", "trade_date", "close", "high", "low", "volume"), "symbol")
    x = x.withColumns({
        "rn": F.row_number().over(w), "_c1": F.lag("close", 1).over(w), "_c6": F.lag("close", 6).over(w),
        "_c21": F.lag("close", 21).over(w), "_v5": F.avg("volume").over(five), "_v20": F.avg("volume").over(twenty),
        "high20": F.max("high").over(twenty), "_n5": F.lead("close", 5).over(w), "_n10": F.lead("close", 10).over(w)})
    x = x.select(
        "symbol", "trade_date", "rn", "high", "low", "high20",
        ((safe_div("_c1", "_c6") - 1) * 100).alias("pre5_pct"), ((safe_div("_c1", "_c21") - 1) * 100).alias("pre20_pct"),
        safe_div("_v5", "_v20").alias("pre_volume_ratio"),
        ((safe_div("_n5", "close") - 1) * 100).alias("post5_pct"), ((safe_div("_n10", "close") - 1) * 100).alias("post10_pct"))
    return materialise(x, "bar-context")


def span_extremes(ctx: DataFrame, longest: int) -> DataFrame:
    """symbol, rn, highs, lows: element k of an array is the extreme of the 2**k bars from rn on (fewer at a symbol's end), for spans of up to `longest`
    bars. Each level is one offset read of the level below, all over one exchange and sort."""
    w, x, k = W.partitionBy("symbol").orderBy("rn"), ctx.select("symbol", "rn", F.col("high").alias("_h0"), F.col("low").alias("_l0")), 0
    while 2 << k <= longest:
        x = x.withColumns({f"_h{k + 1}": F.greatest(f"_h{k}", F.lead(f"_h{k}", 1 << k).over(w)), f"_l{k + 1}": F.least(f"_l{k}", F.lead(f"_l{k}", 1 << k).over(w))})
        k += 1
    return x.select("symbol", "rn", F.array(*[f"_h{i}" for i in range(k + 1)]).alias("highs"), F.array(*[f"_l{i}" for i in range(k + 1)]).alias("lows"))


def locate(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """entry_rn = first bar on or after the open date, exit_rn = last bar on or before the close date, status."""
    ctx = bars if "rn" in bars.columns else bar_context(bars)
    known = ctx.select("symbol").distinct().withColumn("_known", F.lit(True))
    facts = ctx.select("symbol", "trade_date", "rn")
    dated = trades.filter(F.col("open_date").isNotNull() & F.col("close_date").isNotNull())
    entry = last_at_or_before(facts.withColumnRenamed("rn", "entry_rn"), dated, "symbol", "trade_date", "open_date",
                              ["entry_rn"], forward=True)
    exit_ = last_at_or_before(facts.withColumnRenamed("rn", "exit_rn"), dated, "symbol", "trade_date", "close_date", ["exit_rn"])
    z = trades.join(entry, ["symbol", "open_date"], "left").join(exit_, ["symbol", "close_date"], "left").join(known, "symbol", "left")
    status = first_match([
        (F.col("_known").isNull() | F.col("open_date").isNull() | F.col("close_date").isNull(), UNVERIFIED),
        (F.col("entry_rn").isNull() | F.col("exit_rn").isNull(), NO_RANGE),
        (F.col("exit_rn") < F.col("entry_rn"), BAD_ORDER)], OK)
    return z.withColumn("bar_status", status).drop("_known")


def enrich(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Location plus all eight measures. The extremes of a holding time are those of two overlapping spans of 2**k bars, one from its first bar and
    one up to its last: two lookups by (symbol, position), whatever its length."""
    ctx = bar_context(bars)
    z = materialise(locate(trades, ctx), "trades-located")
    ok = F.col("bar_status") == OK
    length = F.col("exit_rn") - F.col("entry_rn") + 1
    longest = z.filter(ok).agg(F.max(length)).first()[0] or 1
    # floor(log2(length)) is the number of binary digits less one.
    z = z.withColumn("_k", F.when(ok, F.length(F.bin(length.cast("long"))) - 1))
    z = z.withColumn("_second", F.col("exit_rn") - F.call_function("shiftleft", F.lit(1), F.col("_k")) + 1)
    spans = span_extremes(ctx, longest)
    at_entry = (ctx.select("symbol", "rn", "pre5_pct", "pre20_pct", "pre_volume_ratio", "high20").join(spans, ["symbol", "rn"])
                .withColumnsRenamed({"rn": "entry_rn", "highs": "_highs", "lows": "_lows"}))
    second = spans.select("symbol", F.col("rn").alias("_second"), F.col("highs").alias("_highs2"), F.col("lows").alias("_lows2"))
    at_exit = ctx.select("symbol", F.col("rn").alias("exit_rn"), "post5_pct", "post10_pct")
    z = (z.join(at_entry, ["symbol", "entry_rn"], "left").join(second, ["symbol", "_second"], "left").join(at_exit, ["symbol", "exit_rn"], "left"))
    z = z.withColumns({"_hi": F.greatest(F.get("_highs", "_k"), F.get("_highs2", "_k")), "_lo": F.least(F.get("_lows", "_k"), F.get("_lows2", "_k"))})
    buy = F.col("buy_price")
    z = z.withColumns({"buy_vs_high20_pct": (safe_div(buy, "high20") - 1) * 100, "mfe_pct": (safe_div("_hi", buy) - 1) * 100,
                       "mae_pct": (safe_div("_lo", buy) - 1) * 100})
    return z.select(*trades.columns, "bar_status", "entry_rn", "exit_rn",
                    *[F.when(F.col("bar_status") == OK, F.col(m)).alias(m) for m in METRICS])


def holding_bucket(days) -> Column:
    d = F.col(days) if isinstance(days, str) else days
    return first_match([(d.isNull(), BUCKET_UNKNOWN), *[(d <= n, label) for n, label in BUCKETS]], BUCKET_LONG)


def grouped_summary(trades: DataFrame) -> DataFrame:
    """By account, by holding bucket, and overall, in one pass of grouping sets."""
    pnl = F.col("pnl")
    g = trades.groupingSets([["account"], ["bucket"], []], "account", "bucket").agg(
        F.count(F.lit(1)).alias("trades"), F.round(F.avg(flag(pnl > 0).cast("double")), 4).alias("win_rate"),
        F.round(F.sum(pnl.cast("decimal(24,4)")), 2).cast("double").alias("pnl"),
        F.round(F.avg("pnl_ratio"), 4).alias("mean_ratio"),
        F.sum(F.when(pnl > 0, pnl)).alias("_g"), F.abs(F.sum(F.when(pnl < 0, pnl))).alias("_l"))
    return g.withColumn("profit_factor", F.round(F.coalesce("_g", F.lit(0.0)) / F.nullif(F.col("_l"), F.lit(0.0)), 4)).drop("_g", "_l")


def outcome_medians(enriched: DataFrame) -> DataFrame:
    """Exact medians of the eight measures for winners and losers."""
    z = enriched.filter(F.col("bar_status") == OK).withColumn("side", F.when(F.col("pnl") > 0, "winner").otherwise("loser"))
    p = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in METRICS]))
    long = z.select("side", p.alias("p")).select("side", "p.measure", "p.v")
    return exact_median(long, ["side", "measure"], "v").withColumn("median", F.round("median", 4))


def outcome_diagnostics(enriched: DataFrame) -> DataFrame:
    z = enriched.filter(F.col("bar_status") == OK)
    loser = ~flag(F.col("pnl") > 0)
    late = loser & flag(F.col("mfe_pct") >= 5)
    return z.agg(
        F.count(F.lit(1)).alias("verified"), F.count_if(late).alias("losers_mfe_5"),
        F.round(F.sum(F.when(late, F.col("pnl").cast("decimal(24,4)"))), 2).cast("double").alias("losers_mfe_5_pnl"),
        F.count_if(loser & flag(F.col("mae_pct") <= -5)).alias("losers_mae_5"),
        F.count_if(flag(F.col("post5_pct") >= 5)).alias("post5_rebound"),
        F.count_if(flag(F.col("post5_pct") <= -5)).alias("post5_fall"))


def merge_histories(copies: DataFrame) -> DataFrame:
    """First usable copy per symbol (lowest copy number), one row per date."""
    usable = copies.filter(F.col("trade_date").isNotNull())
    first = usable.groupBy("symbol").agg(F.min("copy").alias("copy"))
    rest = [c for c in copies.columns if c not in ("symbol", "trade_date")]
    z = usable.join(first, ["symbol", "copy"], "left_semi")
    return (z.groupBy("symbol", "trade_date").agg(F.min_by(F.struct(*rest), F.struct(*rest)).alias("_r"))
            .select("symbol", "trade_date", *[F.col(f"_r.{c}").alias(c) for c in rest]))
