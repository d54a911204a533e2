"""Catalog queries against DuckDB. A sample by default; BARLOOM_FULL=1 runs all."""

import os

import pytest

from barloom.plans import load_catalog

SF = "/root/testdata/sf0.001"
SAMPLE = ["feature_contraction_votes", "limit_up_evidence", "breakout_stage", "stage1_audit", "rank_and_audit_capacity", "trade_cycles",
          "positions", "active_lots", "exit_after_close", "evaluate_recommendations", "actual_outcomes", "trades_enriched", "trades_grouped",
          "breadth_row", "market_context", "sector_leaders", "attribution", "entry_gate", "rolling_pool", "decision_coverage",
          "registry_merged", "closed_day_outcomes", "target_trade_date", "document_identity", "feed_candidates",
          "stream_bars_5m", "stream_latest", "stream_exit_alerts", "stream_ingest", "stream_late_data", "stream_breadth", "feedback_twice",
          "sector_readiness", "tail_post_gate", "source_fingerprint", "active_trades", "json_answers", "concept_match", "membership_coverage", "membership_source_coverage",
          "ledger_append", "pool_files", "opinion_consensus", "batch_identity"]
CAT = load_catalog()


@pytest.mark.parametrize("name", sorted(CAT.QUERIES) if os.environ.get("BARLOOM_FULL") else SAMPLE)
def test_query_matches_oracle(spark, name):
    from check_oracle import compare, connect
    res = compare(spark, connect(SF), SF, name, CAT.QUERIES[name], CAT.ORACLE.get(name))
    assert res.startswith("ok"), res


def test_every_query_has_an_oracle():
    assert set(CAT.ORACLE) == set(CAT.QUERIES)
