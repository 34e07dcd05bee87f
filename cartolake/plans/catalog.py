"""All relational, spatial and planning queries, by the ids of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartolake.plans import aggregates, classify, extracts, filters, geometry, joins, landing, messages, more, ranking, registry, resolution, scalars, sets, sinks, streams, templates, windows

MODULES = (filters, joins, aggregates, windows, ranking, sets, scalars, sinks, resolution, streams, more, classify, geometry, landing, messages, extracts, templates)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLE
