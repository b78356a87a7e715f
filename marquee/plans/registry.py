"""Catalogue of queries with their oracles."""

from __future__ import annotations

from .testviews import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The oracles without the views' text.
BODIES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir); the oracle may read the views."""

    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name], BODIES[name] = with_views(oracle), oracle
        return f

    return put
