"""Filters over the flow catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("info", "warning", "error", "critical")


def changed_since(flows: DataFrame, at, column: str = "modified_at") -> DataFrame:
    return flows.where(F.col(column) >= at)


def flow_scope(flows: DataFrame, types: list[str] | None = None, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Flows of the scope (all, by type or by id), and the wanted ids that are unknown."""
    if ids is None:
        return (flows.where(F.col("type").isin(types)) if types else flows), None
    wanted = ids.select("flow_id").distinct()
    return flows.join(wanted, "flow_id", "left_semi"), wanted.join(flows, "flow_id", "left_anti")


def severity_at_least(column, least: str):
    rank = F.create_map(*(F.lit(x) for p in zip(SEVERITIES, range(len(SEVERITIES))) for x in p))
    return F.coalesce(F.element_at(rank, column) >= SEVERITIES.index(least), F.lit(False))


def drop_reserved(column, reserved: list[str]):
    """A map without the reserved keys."""
    return F.map_filter(column, lambda k, v: ~k.isin(reserved))


def list_flows(raw: DataFrame, types: list[str] | None = None, divisions: list[int] | None = None) -> DataFrame:
    """The flows of a discovery: types in lower case, a flow found on several pages once, those of the wanted types and divisions."""
    rows = raw.withColumn("type", F.lower("type")).dropDuplicates(["flow_id"])
    if types:
        rows = rows.where(F.col("type").isin([t.lower() for t in types]))
    return rows.where(F.col("division_id").isin(divisions)) if divisions else rows
