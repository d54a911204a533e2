"""The whole screen, point in time: bars to candidates, one row set per trade date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.evidence import metrics_panel
from barloom.operators.screen import V5, RuleSet, align_candidates, selected_only, stage1, stage2, stage3
from barloom.session import materialise


def funnel(bars: DataFrame, registry: DataFrame | None = None, rules: RuleSet = V5, cap: int = 50,
           depth: int = 250, by=("trade_date",), cut: bool = True) -> dict[str, DataFrame]:
    """Audits of all stages and the aligned candidates.

    The wide panel is written once to the shared folder (`cut`), because each ranking reads it twice: for
    the score histogram and for the rows. Deeper stages only see survivors, which is a filter, not a rescan.
    """
    if registry is not None:
        bars = bars.join(registry.select("symbol"), "symbol", "left_semi")
    panel = metrics_panel(bars, depth)
    if cut:
        panel = materialise(panel, "panel")
    keep = materialise if cut else (lambda df, _label: df)
    # Audits stay views of the written panel; only survivors are written, because the next stage reads them twice.
    a1 = stage1(panel, rules=rules, by=by)
    a2 = stage2(keep(selected_only(a1), "survivors1"), rules=rules, by=by)
    a3 = keep(stage3(keep(selected_only(a2), "survivors2"), rules=rules, by=by), "audit3")
    out = {"panel": panel, "audit1": a1, "audit2": a2, "audit3": a3}
    if rules.generation >= 5:
        out["aligned"] = align_candidates(a3, cap, by)
    return out


def without_history(bars: DataFrame, active: DataFrame) -> DataFrame:
    """Active symbols that have no bar. Bars shrink to their symbols before the join."""
    return active.select("symbol").join(bars.select("symbol").distinct(), "symbol", "left_anti")


def assert_history(bars: DataFrame, active: DataFrame) -> None:
    """Job failure if any active symbol has no bar. A listing without a code names no symbol and is not counted."""
    row = without_history(bars, active).distinct().agg(F.count("symbol").alias("n"), F.min("symbol").alias("least")).first()
    if row["n"]:
        raise RuntimeError(f"stored history is incomplete: {row['n']} active symbols have no bar, the first is {row['least']}")


def revision_replay(bars: DataFrame, active: DataFrame, depth: int = 260, **kw) -> dict[str, DataFrame]:
    """Recompute the stages from stored history only. Symbols without history end the job before any stage: a pool
    of the others would rank and cut without them. `without_history` lists them."""
    assert_history(bars, active)
    return funnel(bars, active, depth=depth, **kw)


def funnel_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows seen and selected per stage: the funnel sizes."""
    out = None
    for name, df in stages.items():
        if "selected" not in df.columns:
            continue
        n = df.agg(F.count(F.lit(1)).alias("seen"), F.count_if("selected").alias("selected")).withColumn("stage", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out.select("stage", "seen", "selected")
