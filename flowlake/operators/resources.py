"""Organization-wide resource graph: node(key, type), edge(src, dst, via)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.tables import materialize


def reference_closure(seeds: DataFrame, node: DataFrame, edge: DataFrame, max_depth: int | None = None) -> DataFrame:
    """key, status, depth and truncated of everything the seeds lead to; missing targets stay and don't expand. With max_depth, keys of
    that depth that lead further are marked truncated."""
    known = node.select("key")
    seen = materialize(seeds.select("key").distinct().withColumn("depth", F.lit(0)), "refs")
    frontier = seen
    for depth in itertools.count(1):
        ahead = frontier.join(known, "key", "left_semi").join(edge.select(F.col("src").alias("key"), "dst"), "key").select(F.col("dst").alias("key")).distinct()
        frontier = materialize(ahead.join(seen, "key", "left_anti").withColumn("depth", F.lit(depth)), "refs")
        if depth == (max_depth or 0) + 1 and max_depth is not None or frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    ends = edge.join(frontier.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("src").alias("key"), F.lit(True).alias("more")).distinct()
    out = seen.join(known.withColumn("known", F.lit(True)), "key", "left").join(ends, "key", "left")
    return out.select("key", F.when(F.col("known"), "resolved").otherwise("not_found").alias("status"), "depth", (F.coalesce("more", F.lit(False)) & (F.col("depth") == F.lit(max_depth))).alias("truncated") if max_depth is not None else F.lit(False).alias("truncated"))


def orphans(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Nodes that nothing points to."""
    return node.join(edge.select(F.col("dst").alias("key")), "key", "left_anti")


def merge_graphs(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Nodes of both, the fresh row of a key first."""
    return fresh.unionByName(previous.join(fresh.select("key"), "key", "left_anti"))


def blast_radius(edge: DataFrame) -> DataFrame:
    """For each target how many references and distinct sources it has."""
    return edge.groupBy("dst").agg(F.count("*").alias("refs"), F.countDistinct("src").alias("sources"))


def unresolved(edge: DataFrame, node: DataFrame) -> DataFrame:
    return edge.join(node.select(F.col("key").alias("dst")), "dst", "left_anti")


def bundle_counts(node: DataFrame, edge: DataFrame) -> DataFrame:
    """One row: resources, references, unresolved references and their distinct types."""
    gone = unresolved(edge, node)
    a = node.agg(F.count("*").alias("resources"), F.countDistinct("type").alias("types"))
    b = edge.agg(F.count("*").alias("refs"))
    c = gone.agg(F.count("*").alias("unresolved"), F.countDistinct(F.element_at(F.split("dst", ":"), 1)).alias("unresolved_types"))
    return a.crossJoin(b).crossJoin(c)  # single rows


def migration_readiness(counts: DataFrame, mode: str = "migration") -> DataFrame:
    ready = (F.lit(mode) == "migration") & (F.col("resources") > 0) & (F.col("unresolved") == 0)
    caveat = F.when(F.col("unresolved") > 0, F.concat(F.lit("unresolved references: "), F.col("unresolved").cast("string")))
    return counts.select("resources", "unresolved", ready.alias("importable"), caveat.alias("caveat"))


def asset_dedupe(asset: DataFrame) -> DataFrame:
    """One row a digest: asset(ord, name, content, used_by)."""
    rows = asset.withColumn("digest", F.concat(F.lit("sha256:"), F.sha2("content", 256))).withColumn("bytes", F.octet_length("content"))
    return rows.groupBy("digest").agg(F.min_by("name", "ord").alias("name"), F.min("bytes").cast("long").alias("bytes"), F.array_sort(F.collect_set("used_by")).alias("used_by"))


def shallow_references(seeds: DataFrame, edge: DataFrame) -> DataFrame:
    """Exactly one level of references of the seeds; never truncated."""
    return edge.join(seeds.select(F.col("key").alias("src")).distinct(), "src", "left_semi").select("src", "dst", "via")


def route_map(route: DataFrame, flow: DataFrame, slots: tuple[str, ...] = ("open", "closed", "holiday")) -> DataFrame:
    """number, slot, flow and whether it is the number's primary (first filled slot): route(numbers array, one column a slot)."""
    primary = F.coalesce(*(F.when(F.col(s).isNotNull(), F.lit(s)) for s in slots))
    rows = route.select(F.explode("numbers").alias("number"), primary.alias("primary"), F.explode(F.create_map(*(x for s in slots for x in (F.lit(s), F.col(s))))).alias("slot", "flow_id"))
    rows = rows.where("flow_id is not null").join(flow, "flow_id")
    return rows.select("number", "slot", "flow_id", "name", (F.col("slot") == F.col("primary")).alias("primary"))
