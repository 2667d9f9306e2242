"""Registered queries: the operators applied to the test star schema, each with an independent SQL oracle."""

from __future__ import annotations

import importlib

FAMILIES = ("composition", "filters", "joins", "aggregates", "estimation", "projection", "rollups", "space", "drift", "validation", "contract", "readers_and_sinks")


def load():
    """Import every family and return (queries, oracles)."""
    from geopanel.plans.registry import ORACLES, QUERIES

    for family in FAMILIES:
        importlib.import_module(f"geopanel.plans.{family}")
    return QUERIES, ORACLES
