"""Checks and gates over decision tables that arrive as input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import first_match, flag
from barloom.functions.scale import attach, top_k, with_scalars
from barloom.operators.concepts import RES_DOWN, RES_MIXED, RES_UP

# Notes appended to a decision's risk text.
NOTE_DOWN = "同期概念客观行情退潮，系统保守降为WAIT"
NOTE_UNKNOWN = "缺少同期板块客观行情，保留为条件观察，待14:40-14:45核验"
NOTE_CAP = "观察池超过{cap}只，按个股结构70%和板块证据30%排序后未入围"
LOW, MID, HIGH = "低", "中", "高"
# Board states that make an observation conditional, and the gate's texts.
UNVERIFIED, DIVERGED = "板块未核验", "同期概念分化"
UNFIT, UNFIT_REASON = "不适合", "市场评估为不适合新开仓"
GATE_REASON, GATE_NOTE = "突破回踩门禁未通过", "程序门禁降级WAIT："


def _violation(df: DataFrame, rule: str, by: list[str]) -> DataFrame:
    return df.select(*by, F.col("symbol").cast("string").alias("symbol"), F.lit(rule).alias("rule"))


def check_coverage(candidates: DataFrame, selected: DataFrame, details: DataFrame, nonselected: DataFrame,
                   cap: int = 10, by=("batch",)) -> DataFrame:
    """Violation rows; empty means the decision table covers its batch exactly."""
    by, key = list(by), [*by, "symbol"]

    def dup(df: DataFrame, rule: str) -> DataFrame:
        return _violation(df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), rule, by)
    parts = [
        dup(selected, "selected_duplicate"), dup(details, "details_duplicate"), dup(nonselected, "nonselected_duplicate"),
        _violation(selected.join(candidates, key, "left_anti"), "selected_outside", by),
        _violation(nonselected.join(candidates, key, "left_anti"), "nonselected_outside", by),
        _violation(selected.join(details, key, "left_anti"), "details_missing", by),
        _violation(details.join(selected, key, "left_anti"), "details_extra", by),
        _violation(nonselected.join(selected, key, "left_semi"), "both", by),
        _violation(candidates.join(selected, key, "left_anti").join(nonselected, key, "left_anti"), "uncovered", by),
        selected.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select(
            *by, F.lit(None).cast("string").alias("symbol"), F.lit("over_cap").alias("rule"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _note(cond, text: str):
    old = F.coalesce("risk", F.lit(""))
    return F.when(cond, F.when(old == "", F.lit(text)).otherwise(F.concat(old, F.lit("；" + text)))).otherwise(F.col("risk"))


def sector_gate(selected: DataFrame, resonance: DataFrame, keys=("symbol",)) -> DataFrame:
    """Retreat waits; unverified drops to low confidence; mixed caps high at medium. Adds state, kept."""
    x = selected.join(resonance.select(*keys, "state"), list(keys), "left").withColumn("state", F.coalesce("state", F.lit("板块未核验")))
    down, unknown = F.col("state") == RES_DOWN, F.col("state").contains("未核验")
    return x.withColumns({
        "decision": F.when(down, "WAIT").otherwise(F.col("decision")),
        "risk": F.when(down, _note(down, NOTE_DOWN)).otherwise(_note(unknown, NOTE_UNKNOWN)),
        "confidence": F.when(unknown, LOW).when((F.col("state") == RES_MIXED) & (F.col("confidence") == HIGH), MID)
        .otherwise(F.col("confidence")), "kept": ~down})


def cap_70_30(selected: DataFrame, resonance: DataFrame, cap: int = 10, by=("batch",)) -> DataFrame:
    """70% own priority, 30% sector evidence when a batch exceeds the cap; the rest wait.

    selected: by..., symbol, priority, position, decision, risk. The position rank comes from a distributed order.
    """
    from barloom.operators.screen import ordered_position
    by = list(by)
    if "state" not in selected.columns:
        selected = selected.join(resonance.select("symbol", "state"), "symbol", "left")
    x = selected.withColumn("_p", -F.coalesce(F.nullif(F.col("priority").cast("double"), F.lit(0.0)), F.lit(999.0)))
    x = x.withColumn("_q", -F.col("position"))
    x = ordered_position(x, by, ["_p", "_q"], "symbol", "_r")
    n = selected.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    x = attach(x, n, by, ["_n"])
    sector = F.when(F.col("state") == RES_UP, 1.0).when(F.col("state") == RES_MIXED, 0.5).otherwise(0.25)
    score = F.round(0.70 * (1 - (F.col("_r") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))) + 0.30 * sector, 6)
    x = x.withColumn("blend_score", F.when(F.col("_n") <= cap, 1.0).otherwise(score))
    over = x.filter(F.col("_n") > cap)
    top = top_k(over, by, [F.col("blend_score").desc(), F.col("_p").desc(), F.col("_r")], cap, ["symbol"]).select(*by, "symbol", F.lit(True).alias("_top"))
    x = attach(x, top, [*by, "symbol"], ["_top"])
    x = x.withColumn("kept", (F.col("_n") <= cap) | F.col("_top").isNotNull())
    return x.withColumns({"decision": F.when(F.col("kept"), F.col("decision")).otherwise("WAIT"),
                          "risk": _note(~F.col("kept"), NOTE_CAP.format(cap=cap))}).drop("_p", "_q", "_r", "_n", "_top")


def observation_pool(pack: DataFrame, decisions: DataFrame, keys=("symbol",)) -> DataFrame:
    """Pack rows of selected decisions with decision columns and identity; sort by priority (nulls last) at the sink. decisions.sector_state decides the
    identity: a board that is not verified, or whose concepts diverge, makes it conditional."""
    d = decisions.select(*keys, "priority", "decision", "confidence", "risk", "sector_state")
    x = pack.join(d, list(keys))
    state = F.coalesce(F.nullif(F.trim("sector_state"), F.lit("")), F.lit(UNVERIFIED))
    verified = ~state.isin(UNVERIFIED, DIVERGED) & ~state.contains("未核验")
    return x.withColumn("identity", F.when(verified, "核心观察").otherwise("条件观察"))


def opinion_context(opinions: DataFrame, days: DataFrame) -> DataFrame:
    """available / stale / unavailable per asked day. opinions: opinion_date; days: trade_date."""
    first = opinions.agg(F.min("opinion_date").alias("_first"))
    o = opinions.select(F.col("opinion_date").alias("trade_date")).distinct().withColumn("_same", F.lit(True))
    z = with_scalars(days.join(o, "trade_date", "left"), first)
    return z.select("trade_date", first_match([(flag(F.col("_same")), "available"), (flag(F.col("_first") < F.col("trade_date")), "stale")],
                                              "unavailable").alias("opinion_status"))


def merge_tail_inputs(pool: DataFrame, snap40: DataFrame, snap45: DataFrame, conf: DataFrame, gate: DataFrame) -> DataFrame:
    """Successive left joins on symbol; snapshot columns are suffixed by their minute."""
    x = pool
    for df, suffix in ((snap40, "_1440"), (snap45, "_1445"), (conf, ""), (gate, "")):
        cols = [c for c in df.columns if c != "symbol" and c + suffix not in x.columns]
        x = x.join(df.select("symbol", *[F.col(c).alias(c + suffix) for c in cols]), "symbol", "left")
    return x


def check_tail_decisions(pool: DataFrame, decisions: DataFrame, market: DataFrame, max_trades: int = 5, by=("batch",)) -> DataFrame:
    """Violation rows of final decisions. decisions: decision, selected, position_pct, zone_low, zone_high, stop, reason.
    market: by..., max_position."""
    by, key = list(by), [*by, "symbol"]
    trade = flag(F.col("decision") == "TRADE")
    lo, hi, st = F.col("zone_low"), F.col("zone_high"), F.col("stop")
    rules = [("position_range", ~flag(F.col("position_pct").between(0, 100))), ("selected_not_trade", flag(F.col("selected")) != trade),
             ("bad_zone", trade & ~flag((lo > 0) & (lo <= hi))), ("bad_stop", trade & ~flag((st > 0) & (st < hi))),
             ("no_reason", F.coalesce(F.trim("reason"), F.lit("")) == "")]
    hits = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules])))
    out = decisions.select(*by, "symbol", hits.alias("rule"))
    out = out.unionByName(_violation(pool.join(decisions, key, "left_anti"), "uncovered", by))
    tot = decisions.groupBy(*by).agg(F.count_if(trade).alias("_n"), F.sum(F.when(trade, F.col("position_pct"))).alias("_sum"))
    tot = tot.join(market, by, "left")
    for rule, cond in (("too_many_trades", F.col("_n") > max_trades), ("position_sum", F.col("_sum") > F.col("max_position"))):
        out = out.unionByName(tot.filter(flag(cond)).select(*by, F.lit(None).cast("string").alias("symbol"), F.lit(rule).alias("rule")))
    return out


def risk_distance(decisions: DataFrame) -> DataFrame:
    mid = (F.col("zone_low") + F.col("zone_high")) / 2
    return decisions.withColumn("risk_distance", (mid - F.col("stop")) / F.nullif(mid, F.lit(0.0)))


def post_gate(selected: DataFrame, gate: DataFrame, market_fit: str = "", keys=("symbol",)) -> DataFrame:
    """Selected rows that the entry gate refuses, or all of them in a market judged unfit, become WAIT with position and zone zeroed;
    why is added to the risk text."""
    x = selected.join(gate.select(*keys, "allowed", "gate_reason"), list(keys), "left")
    unfit = market_fit == UNFIT
    x = x.withColumn("_w", ~flag(F.col("allowed")) | F.lit(unfit))
    why = F.lit(UNFIT_REASON) if unfit else F.coalesce("gate_reason", F.lit(GATE_REASON))
    note = F.concat(F.coalesce("risk", F.lit("")), F.when(F.coalesce("risk", F.lit("")) != "", "；").otherwise(""), F.lit(GATE_NOTE), why)
    return x.withColumns({"decision": F.when(F.col("_w"), "WAIT").otherwise(F.col("decision")),
                          **{c: F.when(F.col("_w"), 0.0).otherwise(F.col(c)) for c in ("position_pct", "zone_low", "zone_high")},
                          "risk": F.when(F.col("_w"), note).otherwise(F.col("risk"))}).drop("_w", "allowed", "gate_reason")
