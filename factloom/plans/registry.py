"""Named queries over the driver tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans.adapters import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "ag1_edge_profile"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name projections in braces."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return add


from factloom.plans import queries_edges, queries_graph, queries_index, queries_lookups, queries_more, queries_service, queries_sources, queries_spans, queries_survey  # noqa: E402, F401
