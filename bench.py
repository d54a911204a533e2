"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.plans import load_catalog  # noqa: E402
from barloom.session import local_session  # noqa: E402

HEADLINE = ["feature_returns", "feature_slopes", "limit_up_evidence", "breakout_stage", "stage1_audit", "stage2_audit", "screening_funnel",
            "trade_cycles", "positions", "active_lots", "exit_intraday", "evaluate_recommendations", "actual_outcomes", "trades_enriched",
            "trade_outcome_medians", "entry_gate", "breadth_row", "market_context", "sector_strength", "attribution", "resonance",
            "rolling_pool", "closed_day_outcomes", "document_quality", "extracted_articles", "weekly_feedback_summary"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, os.environ.get("BENCH_MEMORY", "16g"))
    names = [a for a in sys.argv[1:]] or HEADLINE
    q, times = load_catalog().QUERIES, {}
    spark.range(1000).selectExpr("sum(id)").collect()   # start-up is not a query
    for n in names:
        t = time.time()
        q[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
