"""All registered queries with their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["text_queries", "date_queries", "citation_queries", "retrieval_queries", "risk_queries", "portfolio_queries", "stream_queries"]


def registry() -> dict:
    found: dict = {}
    for m in MODULES:
        for name, entry in importlib.import_module(f"clausegrid.plans.{m}").QUERIES.items():
            if name in found:
                raise ValueError(f"query registered twice: {name}")
            found[name] = entry
    return dict(sorted(found.items()))
