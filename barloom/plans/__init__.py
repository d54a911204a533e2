"""Compositions of operators, and the catalog of named queries."""

import importlib


def load_catalog():
    from barloom.plans import catalog
    for m in ("q_features", "q_ledger", "q_market", "q_ingest", "q_opinions", "q_streams"):
        importlib.import_module(f"barloom.plans.{m}")
    return catalog
