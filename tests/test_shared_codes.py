"""Suppliers whose keys give one code share a symbol: queries against their SQL where that is so."""

import check_oracle as co
import duckdb
import pytest

from barloom.plans import load_catalog

CAT = load_catalog()
SMALL = "/root/testdata/sf0.001"
LEDGER = ("active_lots", "actual_outcomes", "actual_trade_summary", "daily_feedback_summary", "due_cohorts", "exit_after_close", "exit_intraday",
          "ledger_balances", "ledger_append", "positions", "trade_cycles")


@pytest.fixture(scope="module")
def shared_codes(tmp_path_factory):
    """The small tables with ten suppliers 1230 to 1239, whose codes are cut to 600123, 300123, 688123 and 920123."""
    d = tmp_path_factory.mktemp("shared-codes")
    con = duckdb.connect()
    for t in co.TABLES:
        keys = {"supplier": "REPLACE (s_suppkey + 1230 AS s_suppkey)", "lineitem": "REPLACE (l_suppkey + 1230 AS l_suppkey)"}.get(t, "")
        con.execute(f"COPY (SELECT * {keys} FROM '{SMALL}/{t}.parquet') TO '{d}/{t}.parquet' (FORMAT parquet)")
    return str(d)


def check(spark, sf, name):
    got = co.compare(spark, co.connect(sf), sf, name, CAT.QUERIES[name], CAT.ORACLE[name])
    assert got.startswith(("ok", "EMPTY")), got


@pytest.mark.parametrize("name", LEDGER)
def test_ledger_of_shared_codes(spark, shared_codes, name):
    check(spark, shared_codes, name)


@pytest.mark.parametrize("name", ("attribution", "attribution_summary", "change_counts", "closed_day_counts", "closed_day_history", "closed_day_outcomes",
                                  "deferred_members", "refresh_plan"))
def test_listings_of_shared_codes(spark, shared_codes, name):
    check(spark, shared_codes, name)


def test_concepts_need_membership_alone(spark, monkeypatch):
    from barloom.operators import sectors
    from barloom.plans import catalog, q_market
    rows = [("1", sectors.CONCEPT, "a"), ("1", sectors.CONCEPT, "b"), ("1", sectors.CONCEPT, "a"), ("1", "x", "c"), ("2", "x", "c"), ("3", sectors.CONCEPT, None)]
    got = {r.symbol: r.concepts for r in sectors.concepts_of(spark.createDataFrame(rows, "symbol string, board_type string, board string")).collect()}
    assert {k: sorted(c, key=str) for k, c in got.items()} == {"1": ["a", "b"], "2": [], "3": [None]}
    monkeypatch.setattr(q_market, "mentions", None)  # neither documents nor conversations are read for it
    assert catalog.QUERIES["resonance"](spark, "/root/testdata/sf0.001").count() > 0
