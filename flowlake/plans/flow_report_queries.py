"""Identity, completeness and dependencies of the flows of view S, a summary of those of view E, and extensions of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import findings as Q
from flowlake.operators import graph as G
from flowlake.operators import reports as R
from flowlake.plans.graph_queries import GRAPH, PATHS
from flowlake.plans.registry import query
from flowlake.plans.views import S_SQL, control_graph, supplier_flows, table

MIMES = [*R.EXTENSIONS, "audio/unknown", "AUDIO/WAV"]
LEVEL = "CASE WHEN l_partkey % 11 = 0 THEN 'unsupported' WHEN l_partkey % 11 = 1 THEN 'opaque' WHEN l_partkey % 11 > 8 THEN 'partial' ELSE 'full' END"
COUNTS = f"""counts AS (SELECT flow_id, count(*) AS source_objects, count(*) FILTER (level <> 'unsupported') AS represented, count(*) FILTER (level = 'unsupported') AS unsupported, count(*) FILTER (level = 'opaque') AS opaque,
  (SELECT count(*) FROM step s WHERE s.flow_id = l.flow_id AND s.to_rn >= 1000000) AS dangling_edges, (SELECT count(*) FROM dependency d WHERE d.flow_id = l.flow_id AND status <> 'resolved') AS unresolved_dependencies FROM (SELECT *, {LEVEL} AS level FROM node) l GROUP BY flow_id)"""


@query(f"WITH {S_SQL}, {COUNTS} SELECT f.flow_id, name, 'sha256:' || sha256('/name' || chr(0) || 'name') AS name_evidence, type, 'sha256:' || sha256('/type' || chr(0) || 'type') AS type_evidence, counts.* EXCLUDE (flow_id) FROM flow f LEFT JOIN counts USING (flow_id)")
def b1_flow_identity(spark, d):
    t = supplier_flows(spark, d)
    part = F.col("l_partkey") % 11
    node = t["node"].withColumn("support_level", F.when(part == 0, "unsupported").when(part == 1, "opaque").when(part > 8, "partial").otherwise("full"))
    return R.identity(t["flow"], R.completeness(node, t["edge"], t["dependency"]))


@query(f"WITH {S_SQL} SELECT flow_id, dependency_id, type, coalesce(display_name, dependency_id) AS label, status, (SELECT count(*) FROM node n WHERE n.flow_id = d.flow_id AND 'd' || n.l_orderkey = d.dependency_id AND n.l_returnflag <> 'A') AS referenced_by, 'sha256:' || sha256(pointer || chr(0) || 'reference') AS evidence_id FROM dependency d")
def b7_dependency_table(spark, d):
    t = supplier_flows(spark, d)
    uses = t["node"].where("source_type <> 'PlayAudioAction'").select("flow_id", F.replace("name", F.lit("Step "), F.lit("d")).alias("dependency_id"), "node_id")
    return R.dependency_table(t["dependency"], uses)


@query(f"WITH {S_SQL} SELECT flow_id, (SELECT count(*) FROM node n WHERE n.flow_id = f.flow_id AND source_type = 'DataAction') AS calling_nodes, (SELECT count(*) FROM dependency d WHERE d.flow_id = f.flow_id AND d.type = 'dataAction') AS dependencies, (SELECT count(*) FROM dependency d WHERE d.flow_id = f.flow_id AND d.type = 'dataAction' AND status <> 'resolved') AS unresolved FROM flow f")
def b7_outside_calls(spark, d):
    t = supplier_flows(spark, d)
    return R.outside_calls(t["flow"], t["node"], t["dependency"])


SHOWN, SAID = 3, 4
MESSAGES = f"""told AS (SELECT flow_id, 0 AS part, 'ODD' AS code, 'odd ' || node_id AS message FROM node WHERE support_level = 'partial'
  UNION ALL SELECT flow_id, 1, 'NODE_UNREACHABLE', name || ' cannot be reached' FROM node ANTI JOIN reach USING (flow_id, node_id)
  UNION ALL SELECT e.flow_id, 1, 'EDGE_DANGLING', coalesce(name, src) || ' points to missing ' || dst FROM edge e LEFT JOIN node n ON n.flow_id = e.flow_id AND n.node_id = e.src WHERE NOT EXISTS (FROM node m WHERE m.flow_id = e.flow_id AND m.node_id = e.dst)),
note AS (SELECT flow_id, message, row_number() OVER (PARTITION BY flow_id ORDER BY part, code, message) AS r FROM told),
main AS (SELECT flow_id, array_to_string(steps, ' -> ') || ' (' || kind || ')' AS text, row_number() OVER (PARTITION BY flow_id ORDER BY array_to_string(steps, ' -> '), kind) AS r FROM journey),
dep AS (SELECT user_id AS flow_id, ['queue', 'userPrompt', 'dataAction'][event_id % 3 + 1] AS type, count(DISTINCT event_type) AS n FROM events GROUP BY ALL)"""


@query(f"""{GRAPH}, {PATHS}, {MESSAGES} SELECT DISTINCT user_id AS flow_id, (SELECT count(*) FROM node n WHERE n.flow_id = user_id) AS nodes, (SELECT count(*) FROM edge e WHERE e.flow_id = user_id) AS edges,
  (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM dep d WHERE d.flow_id = user_id) AS dependency_counts, coalesce((SELECT string_agg(text, '|' ORDER BY r) FROM main m WHERE m.flow_id = user_id AND r <= {SHOWN}), '') AS main_paths, coalesce((SELECT string_agg(message, '|' ORDER BY r) FROM note m WHERE m.flow_id = user_id AND r <= {SAID}), '') AS warnings FROM events""")
def b15_flow_inspection(spark, d):
    node, edge, entry = control_graph(spark, d)
    events = table(spark, d, "events").withColumnRenamed("user_id", "flow_id")
    kind = F.element_at(F.array(*map(F.lit, ("queue", "userPrompt", "dataAction"))), (F.col("event_id") % 3 + 1).cast("int"))
    warning = node.where("support_level = 'partial'").select("flow_id", F.lit("ODD").alias("code"), F.concat(F.lit("odd "), "node_id").alias("message"))
    found = Q.node_unreachable(node, G.reachability(node, edge, entry)).unionByName(Q.edge_dangling(node, edge)).unionByName(Q.semantics_unmodelled(node))
    out = R.inspection(events.select("flow_id").distinct(), node, edge, events.select("flow_id", kind.alias("type"), "event_type").distinct(), G.journeys(node, edge, entry, max_journeys=None), warning, found, SHOWN, SAID)
    counts = F.array_join(F.transform("dependency_counts", lambda x: F.concat_ws("=", x["type"], x["n"].cast("string"))), ",")
    return out.withColumns({"dependency_counts": counts, "main_paths": F.array_join("main_paths", "|"), "warnings": F.array_join("warnings", "|")})


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'wav' WHEN 1 THEN 'wav' WHEN 2 THEN 'mp3' WHEN 3 THEN 'ogg' WHEN 4 THEN 'pdf' ELSE 'bin' END AS extension FROM events")
def f18_file_extension(spark, d):
    mime = F.element_at(F.array(*map(F.lit, MIMES)), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", R.asset_extension(mime).alias("extension"))
