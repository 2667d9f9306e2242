"""Operators for preparing training text at scale. Nothing else in the library imports this package."""

from __future__ import annotations


def load():
    """Import every operator's query and return (queries, oracles)."""
    from geopanel.llm import plans

    return dict(plans.QUERIES), dict(plans.ORACLES)
