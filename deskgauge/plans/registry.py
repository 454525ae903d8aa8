"""All registered queries: importing a query module registers what it defines."""

from __future__ import annotations

import importlib

from deskgauge.plans import catalog

MODULES = ("metric_queries", "quality_queries", "peer_queries", "money_queries", "decision_queries", "text_queries", "source_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"deskgauge.plans.{name}")


def queries() -> dict[str, catalog.Query]:
    _load()
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(catalog.ORACLES)
