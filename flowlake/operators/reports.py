"""Reports of normalized flows as tables: identity and completeness, dependencies and outside calls, and a summary for a quick look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.operators.evidence import bounded_first, evidence_id

# Extensions of stored recordings and files by type, the node type of outside calls, and the severities that a summary tells.
EXTENSIONS = {"audio/wav": "wav", "audio/x-wav": "wav", "audio/mpeg": "mp3", "audio/ogg": "ogg", "application/pdf": "pdf"}
OUTSIDE_CALL, OUTSIDE_TYPE, TOLD = "DataAction", "dataAction", ["warning", "error", "critical"]
MAIN_PATHS, WARNINGS = 10, 50


def asset_extension(mime: Column) -> Column:
    """The extension of a type, or bin; types are compared as they stand."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in EXTENSIONS.items() for x in p)), mime), F.lit("bin"))


def completeness(node: DataFrame, edge: DataFrame, dependency: DataFrame) -> DataFrame:
    """Six counts a flow with nodes: objects, represented, unsupported and opaque ones, edges with an end that is no node, and
    dependencies that did not resolve. An edge counts once, however often a node id repeats."""
    ids = node.select("flow_id", "node_id").distinct()
    level = F.col("support_level")
    own = node.groupBy("flow_id").agg(F.count("*").alias("source_objects"), F.count_if(F.coalesce(level != "unsupported", F.lit(True))).alias("represented"), F.count_if(level == "unsupported").alias("unsupported"), F.count_if(level == "opaque").alias("opaque"))
    at = lambda end: ids.select("flow_id", F.col("node_id").alias(end), F.lit(True).alias(f"has_{end}"))
    ends = edge.select("flow_id", "src", "dst").join(at("src"), ["flow_id", "src"], "left").join(at("dst"), ["flow_id", "dst"], "left")
    dangling = ends.where("has_src is null or has_dst is null").groupBy("flow_id").agg(F.count("*").alias("dangling_edges"))
    lost = dependency.where("status is null or status <> 'resolved'").groupBy("flow_id").agg(F.count("*").alias("unresolved_dependencies"))
    out = own.join(dangling, "flow_id", "left").join(lost, "flow_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("dangling_edges", "unresolved_dependencies")})


def identity(flow: DataFrame, counts: DataFrame) -> DataFrame:
    """Each flow with the evidence of its name and type and its completeness; a flow without nodes has null counts, not zeros."""
    proof = lambda field: evidence_id(F.lit(f"/{field}"), F.lit(field)).alias(f"{field}_evidence")
    return flow.select("flow_id", "name", proof("name"), "type", proof("type")).join(counts, "flow_id", "left")


def dependency_table(dependency: DataFrame, reference: DataFrame) -> DataFrame:
    """flow_id, dependency_id, type, label, status, referenced_by (how many nodes) and evidence_id of each dependency;
    reference(flow_id, dependency_id, node_id)."""
    met = reference.groupBy("flow_id", "dependency_id").agg(F.countDistinct("node_id").alias("referenced_by"))
    rows = dependency.join(met, ["flow_id", "dependency_id"], "left")
    return rows.select("flow_id", "dependency_id", "type", F.coalesce("display_name", "dependency_id").alias("label"), "status", F.coalesce("referenced_by", F.lit(0)).alias("referenced_by"), evidence_id(F.col("pointer"), F.lit("reference")).alias("evidence_id"))


def outside_calls(flow: DataFrame, node: DataFrame, dependency: DataFrame) -> DataFrame:
    """flow_id with how many dependencies and nodes call out, for every flow, and how many of these dependencies did not resolve."""
    nodes = node.where(F.col("source_type") == OUTSIDE_CALL).groupBy("flow_id").agg(F.count("*").alias("calling_nodes"))
    held = dependency.where(F.col("type") == OUTSIDE_TYPE).groupBy("flow_id").agg(F.count("*").alias("dependencies"), F.count_if(F.coalesce(F.col("status") != "resolved", F.lit(True))).alias("unresolved"))
    out = flow.select("flow_id").join(nodes, "flow_id", "left").join(held, "flow_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("calling_nodes", "dependencies", "unresolved")})


def inspection(flow: DataFrame, node: DataFrame, edge: DataFrame, dependency: DataFrame, journey: DataFrame, warning: DataFrame, finding: DataFrame, paths: int = MAIN_PATHS, messages: int = WARNINGS) -> DataFrame:
    """One row a flow: node and edge counts, dependencies by type, the first paths as text and the first messages.

    Paths come in ascending order of their steps; messages are those of the capture's warnings(flow_id, code, message), then those of
    findings of at least a warning, each by code and text. Lists are capped ahead of the shuffle that packs them."""
    sizes = lambda rows, name: rows.groupBy("flow_id").agg(F.count("*").alias(name))
    types = dependency.groupBy("flow_id", "type").agg(F.count("*").alias("n")).groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("dependency_counts"))
    told = journey.select("flow_id", F.concat(F.array_join("steps", " -> "), F.lit(" ("), "kind", F.lit(")")).alias("text"), F.array_join("steps", " -> ").alias("order"), "kind")
    some = warning.select("flow_id", F.lit(0).alias("part"), "code", "message").unionByName(finding.where(F.col("severity").isin(TOLD)).select("flow_id", F.lit(1).alias("part"), "code", "message"))
    packed = lambda rows, column, name: rows.groupBy("flow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(column).alias("x")))), lambda s: s["x"]).alias(name))
    main = packed(bounded_first(told, ["flow_id"], ["order", "kind"], paths)[0], "text", "main_paths")
    notes = packed(bounded_first(some, ["flow_id"], ["part", "code", "message"], messages)[0], "message", "warnings")
    out = flow.select("flow_id")
    for part in (sizes(node, "nodes"), sizes(edge, "edges"), types, main, notes):
        out = out.join(part, "flow_id", "left")
    lists = ("dependency_counts", "main_paths", "warnings")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("nodes", "edges")}).withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in lists})
