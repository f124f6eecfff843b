"""Registered queries over the driver tables and their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("summaries", "detection", "vectors", "tables", "media")


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for family in FAMILIES:
        module = import_module(f"gaugeframe.workload.{family}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
