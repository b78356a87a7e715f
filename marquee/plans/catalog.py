"""All queries over the given tables, by the inventory's numbers."""

from . import q_aggregates, q_filters, q_match, q_scalars, q_sources, q_streams  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
