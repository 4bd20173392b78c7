"""Control-graph, findings, aggregation and window queries over view E (and V for variables)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlake.operators import findings as Q
from flowlake.operators import graph as G
from flowlake.plans.registry import query
from flowlake.plans.views import E_SQL, V_SQL, control_graph, variables

VALID = "valid AS (SELECT e.* FROM edge e WHERE EXISTS (FROM node n WHERE n.flow_id = e.flow_id AND n.node_id = e.dst) AND EXISTS (FROM node n WHERE n.flow_id = e.flow_id AND n.node_id = e.src))"
REACH = "reach AS (SELECT flow_id, node_id FROM entry SEMI JOIN node USING (flow_id, node_id) UNION SELECT v.flow_id, v.dst FROM reach r JOIN valid v ON v.flow_id = r.flow_id AND v.src = r.node_id)"
TERMINAL = "terminal AS (SELECT * FROM node n WHERE NOT EXISTS (FROM edge e JOIN node m ON m.flow_id = e.flow_id AND m.node_id = e.dst WHERE e.flow_id = n.flow_id AND e.src = n.node_id))"
CLOSURE = "closure AS (SELECT flow_id, src, dst FROM valid UNION SELECT c.flow_id, c.src, v.dst FROM closure c JOIN valid v ON v.flow_id = c.flow_id AND v.src = c.dst)"
SCC = "member AS (SELECT a.flow_id, a.src AS node_id, min(a.dst) AS component FROM closure a JOIN closure b ON a.flow_id = b.flow_id AND a.src = b.dst AND a.dst = b.src GROUP BY ALL), scc AS (SELECT flow_id, component, count(*) AS size, list_sort(list(node_id)) AS nodes FROM member GROUP BY ALL)"
KIND = "CASE WHEN source_type = 'DisconnectAction' THEN 'disconnect' WHEN source_type IN ('TransferMenuAction', 'TransferTaskAction', 'CallTaskAction', 'TaskAction', 'MenuAction', 'PreviousMenuAction') THEN 'other' WHEN contains(source_type, 'Transfer') THEN 'transfer' ELSE 'other' END"
GRAPH = f"WITH RECURSIVE {E_SQL}, {VALID}, {REACH}, {TERMINAL}, {CLOSURE}, {SCC}"
PATHS = f"""path AS (SELECT e.flow_id, e.node_id AS at, [e.node_id] AS steps, FALSE AS loop FROM entry e SEMI JOIN node USING (flow_id, node_id)
  UNION ALL SELECT p.flow_id, v.dst, list_append(p.steps, v.dst), list_contains(p.steps, v.dst) FROM path p JOIN node n ON n.flow_id = p.flow_id AND n.node_id = p.at
  JOIN valid v ON v.flow_id = p.flow_id AND v.src = p.at WHERE NOT p.loop AND {KIND} = 'other'),
journey AS (SELECT p.flow_id, CASE WHEN loop THEN 'loop' WHEN {KIND} <> 'other' THEN {KIND} ELSE 'dead-end' END AS kind, steps FROM path p JOIN node n ON n.flow_id = p.flow_id AND n.node_id = p.at
  WHERE loop OR {KIND} <> 'other' OR NOT EXISTS (FROM valid v WHERE v.flow_id = p.flow_id AND v.src = p.at))"""


@query(GRAPH + " SELECT * FROM reach")
def g1_reachability(spark, d):
    return G.reachability(*control_graph(spark, d)).select("flow_id", "node_id")


@query(GRAPH + " SELECT flow_id, edge_id, src, dst FROM edge e WHERE NOT EXISTS (FROM node n WHERE n.flow_id = e.flow_id AND n.node_id = e.dst)")
def g2_dangling_edges(spark, d):
    node, edge, _ = control_graph(spark, d)
    return G.dangling_edges(node, edge).select("flow_id", "edge_id", "src", "dst")


@query(GRAPH + f" SELECT flow_id, node_id, {KIND} AS exit_kind FROM terminal")
def g3_terminal_nodes(spark, d):
    node, edge, _ = control_graph(spark, d)
    return G.terminal_nodes(node, edge).select("flow_id", "node_id", G.exit_kind().alias("exit_kind"))


@query(GRAPH + " SELECT flow_id, node_id FROM node n ANTI JOIN reach USING (flow_id, node_id)")
def g4_unreachable_nodes(spark, d):
    node, edge, entry = control_graph(spark, d)
    return G.unreachable_nodes(node, G.reachability(node, edge, entry)).select("flow_id", "node_id")


@query(GRAPH + " SELECT flow_id, component, size, array_to_string(nodes, ',') AS nodes FROM scc")
def g5_strong_components(spark, d):
    node, edge, _ = control_graph(spark, d)
    return G.strongly_connected_components(node, edge).withColumn("nodes", F.array_join("nodes", ","))


@query(GRAPH + " SELECT DISTINCT flow_id, node_id FROM member")
def g6_nodes_in_cycles(spark, d):
    node, edge, _ = control_graph(spark, d)
    return G.nodes_in_cycles(G.strongly_connected_components(node, edge))


@query(GRAPH + f", {PATHS} SELECT flow_id, kind, array_to_string(steps, '>') AS steps FROM journey")
def g7_journeys(spark, d):
    return G.journeys(*control_graph(spark, d), max_journeys=None).withColumn("steps", F.array_join("steps", ">"))


@query()
def g7_journeys_capped(spark, d):
    return G.journeys(*control_graph(spark, d)).withColumn("steps", F.array_join("steps", ">"))


@query(GRAPH + " SELECT flow_id, src AS node_id, array_to_string(list_sort(list(label)), ',') AS offers FROM edge WHERE role = 'menu-choice' AND length(label) > 0 GROUP BY ALL")
def g14_menu_offers(spark, d):
    return G.menu_offers(control_graph(spark, d)[1]).withColumn("offers", F.array_join("offers", ","))


@query(GRAPH + f", {PATHS} SELECT flow_id, count(*) FILTER (kind = 'transfer') AS transfers, count(*) FILTER (kind = 'disconnect') AS disconnects, count(*) FILTER (kind = 'dead-end') AS dead_ends, count(*) FILTER (kind = 'loop') AS loops, min(len(steps)) AS least, max(len(steps)) AS most FROM journey GROUP BY ALL")
def a5_journey_counts(spark, d):
    j = G.journeys(*control_graph(spark, d), max_journeys=None)
    kinds = {"transfers": "transfer", "disconnects": "disconnect", "dead_ends": "dead-end", "loops": "loop"}
    return j.groupBy("flow_id").agg(*(F.count_if(F.col("kind") == k).alias(c) for c, k in kinds.items()), F.min(F.size("steps")).alias("least"), F.max(F.size("steps")).alias("most"))


@query(f"WITH {V_SQL}, c AS (SELECT flow_id, variable_id, count(*) FILTER (mode = 'read') AS reads, count(*) FILTER (mode = 'write') AS writes FROM variable LEFT JOIN variable_use USING (flow_id, variable_id) GROUP BY ALL) SELECT flow_id, CAST(variable_id AS VARCHAR) AS subject, 'read ' || reads || ' times, never written' AS message FROM c WHERE reads > 0 AND writes = 0")
def q1_read_never_written(spark, d):
    return Q.read_never_written(Q.variable_counts(*variables(spark, d))).select("flow_id", "subject", "message")


@query(f"WITH {V_SQL} SELECT flow_id, CAST(variable_id AS VARCHAR) AS subject FROM variable ANTI JOIN variable_use USING (flow_id, variable_id)")
def q2_declared_unused(spark, d):
    return Q.declared_unused(Q.variable_counts(*variables(spark, d))).select("flow_id", "subject")


@query(GRAPH + " SELECT flow_id, 'NODE_UNREACHABLE' AS code, node_id AS subject, name || ' cannot be reached' AS message FROM node ANTI JOIN reach USING (flow_id, node_id)")
def q3_node_unreachable(spark, d):
    node, edge, entry = control_graph(spark, d)
    return Q.node_unreachable(node, G.reachability(node, edge, entry)).select("flow_id", "code", "subject", "message")


@query(GRAPH + " SELECT e.flow_id, edge_id AS subject, coalesce(name, src) || ' points to missing ' || dst AS message FROM edge e LEFT JOIN node n ON n.flow_id = e.flow_id AND n.node_id = e.src WHERE NOT EXISTS (FROM node m WHERE m.flow_id = e.flow_id AND m.node_id = e.dst)")
def q4_edge_dangling(spark, d):
    node, edge, _ = control_graph(spark, d)
    return Q.edge_dangling(node, edge).select("flow_id", "subject", "message")


@query(GRAPH + f" SELECT e.flow_id, e.dst AS subject, array_to_string(list_sort(list(DISTINCT e.src)), ',') AS nodes FROM edge e JOIN terminal t ON t.flow_id = e.flow_id AND t.node_id = e.dst WHERE e.label IS NOT NULL AND {KIND} = 'other' GROUP BY ALL")
def q5a_branch_terminates(spark, d):
    node, edge, _ = control_graph(spark, d)
    return Q.branch_terminates_nowhere(node, edge).select("flow_id", "subject", F.array_join("nodes", ",").alias("nodes"))


@query(GRAPH + " SELECT flow_id, component AS subject, size || ' nodes in a cycle' AS message FROM scc")
def q5b_cycle_present(spark, d):
    node, edge, _ = control_graph(spark, d)
    return Q.cycle_present(G.strongly_connected_components(node, edge)).select("flow_id", "subject", "message")


@query(GRAPH + " SELECT flow_id, node_id AS subject, name || ' is modelled in part' AS message FROM node WHERE support_level = 'partial'")
def q5d_semantics_unmodelled(spark, d):
    return Q.semantics_unmodelled(control_graph(spark, d)[0]).select("flow_id", "subject", "message")


FOUND = GRAPH + f""", found AS (SELECT flow_id, 'warning' AS severity FROM node ANTI JOIN reach USING (flow_id, node_id)
  UNION ALL SELECT flow_id, 'error' FROM edge e WHERE NOT EXISTS (FROM node n WHERE n.flow_id = e.flow_id AND n.node_id = e.dst)
  UNION ALL (SELECT DISTINCT ON (e.flow_id, e.dst) e.flow_id, 'warning' FROM edge e JOIN terminal t ON t.flow_id = e.flow_id AND t.node_id = e.dst WHERE e.label IS NOT NULL AND {KIND} = 'other')
  UNION ALL SELECT flow_id, 'info' FROM scc UNION ALL SELECT flow_id, 'info' FROM node WHERE support_level = 'partial')"""


@query(FOUND + " SELECT flow_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM found GROUP BY ALL")
def a6_findings_by_severity(spark, d):
    return Q.by_severity(Q.graph_findings(*control_graph(spark, d)))


@query(GRAPH + " SELECT role, count(*) AS edges, count(DISTINCT flow_id) AS flows FROM edge GROUP BY ALL")
def a1_count_by(spark, d):
    return control_graph(spark, d)[1].groupBy("role").agg(F.count("*").alias("edges"), F.countDistinct("flow_id").alias("flows"))


@query(GRAPH + " SELECT flow_id, source_type, count(*) AS nodes, array_to_string(list_sort(list(DISTINCT node_id))[1:20], ',') AS sample FROM node GROUP BY ALL")
def a2_node_counts(spark, d):
    node = control_graph(spark, d)[0]
    return node.groupBy("flow_id", "source_type").agg(F.count("*").alias("nodes"), F.array_join(F.slice(F.array_sort(F.collect_set("node_id")), 1, 20), ",").alias("sample"))


@query(GRAPH + " SELECT flow_id, arg_max(component, size * 1000 - ascii(component)) AS component, max(size) AS size FROM scc GROUP BY ALL")
def a15_largest_component(spark, d):
    node, edge, _ = control_graph(spark, d)
    rank = F.col("size") * 1000 - F.ascii("component")
    return G.strongly_connected_components(node, edge).groupBy("flow_id").agg(F.max_by("component", rank).alias("component"), F.max("size").alias("size"))


@query(GRAPH + " SELECT flow_id, node_id, dense_rank() OVER (PARTITION BY flow_id ORDER BY ord, node_id) AS mark FROM node")
def w1_citation_numbers(spark, d):
    w = Window.partitionBy("flow_id").orderBy("ord", "node_id")
    return control_graph(spark, d)[0].select("flow_id", "node_id", F.dense_rank().over(w).cast("long").alias("mark"))


@query(GRAPH + " SELECT flow_id, node_id, (row_number() OVER (PARTITION BY flow_id ORDER BY node_id) - 1) // 2 AS part FROM node")
def w3_chunks(spark, d):
    w = Window.partitionBy("flow_id").orderBy("node_id")
    return control_graph(spark, d)[0].select("flow_id", "node_id", F.floor((F.row_number().over(w) - 1) / 2).cast("long").alias("part"))


@query(GRAPH + " SELECT f.flow_id, nodes, reachable, nodes - reachable AS unreachable, coalesce(dangling, 0) AS dangling FROM (SELECT flow_id, count(*) AS nodes FROM node GROUP BY 1) f LEFT JOIN (SELECT flow_id, count(*) AS reachable FROM reach GROUP BY 1) USING (flow_id) LEFT JOIN (SELECT flow_id, count(*) AS dangling FROM edge e WHERE NOT EXISTS (FROM node n WHERE n.flow_id = e.flow_id AND n.node_id = e.dst) GROUP BY 1) USING (flow_id)")
def v4_reachability_summary(spark, d):
    node, edge, entry = control_graph(spark, d)
    reached = G.reachability(node, edge, entry).groupBy("flow_id").agg(F.count("*").alias("reachable"))
    dangling = G.dangling_edges(node, edge).groupBy("flow_id").agg(F.count("*").alias("dangling"))
    out = node.groupBy("flow_id").agg(F.count("*").alias("nodes")).join(reached, "flow_id", "left").join(dangling, "flow_id", "left")
    return out.select("flow_id", "nodes", "reachable", (F.col("nodes") - F.col("reachable")).alias("unreachable"), F.coalesce("dangling", F.lit(0)).alias("dangling"))


@query(GRAPH + " SELECT e.flow_id, coalesce(a.name, e.src) AS from_name, e.role, e.label, coalesce(b.name, e.dst) AS to_name FROM edge e LEFT JOIN node a ON a.flow_id = e.flow_id AND a.node_id = e.src LEFT JOIN node b ON b.flow_id = e.flow_id AND b.node_id = e.dst")
def b4_branch_table(spark, d):
    node, edge, _ = control_graph(spark, d)
    named = lambda end: node.select("flow_id", F.col("node_id").alias(end), F.col("name").alias(f"{end}_name"))
    out = edge.join(named("src"), ["flow_id", "src"], "left").join(named("dst"), ["flow_id", "dst"], "left")
    return out.select("flow_id", F.coalesce("src_name", "src").alias("from_name"), "role", "label", F.coalesce("dst_name", "dst").alias("to_name"))


@query(GRAPH + " SELECT n.flow_id, node_id FROM node n WHERE NOT EXISTS (FROM edge e WHERE e.flow_id = n.flow_id AND e.dst = n.node_id)")
def n16_entry_nodes(spark, d):
    node, edge, _ = control_graph(spark, d)
    return node.join(edge.select("flow_id", F.col("dst").alias("node_id")), ["flow_id", "node_id"], "left_anti").select("flow_id", "node_id")


@query(GRAPH + " SELECT n.flow_id, count(*) AS nodes, count(*) FILTER (support_level = 'partial') AS partial, (SELECT count(*) FROM edge e WHERE e.flow_id = n.flow_id AND NOT EXISTS (FROM valid v WHERE v.flow_id = e.flow_id AND v.edge_id = e.edge_id)) AS dangling_any FROM node n GROUP BY n.flow_id")
def n18_completeness(spark, d):
    node, edge, _ = control_graph(spark, d)
    bad = edge.join(G.valid_edges(node, edge), ["flow_id", "edge_id"], "left_anti").groupBy("flow_id").agg(F.count("*").alias("dangling_any"))
    out = node.groupBy("flow_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("support_level") == "partial").alias("partial"))
    return out.join(bad, "flow_id", "left").withColumn("dangling_any", F.coalesce("dangling_any", F.lit(0)))


@query(f"WITH {V_SQL} SELECT flow_id, variable_id, count(*) FILTER (mode = 'read') AS reads, count(*) FILTER (mode = 'write') AS writes FROM variable LEFT JOIN variable_use USING (flow_id, variable_id) GROUP BY ALL")
def b5_variable_counts(spark, d):
    return Q.variable_counts(*variables(spark, d))


@query(f"WITH {V_SQL} SELECT flow_id, node_id, array_to_string(list_sort(list(variable_id)), ',') AS reads FROM variable_use WHERE mode = 'read' GROUP BY ALL")
def j7_inversion(spark, d):
    use = variables(spark, d)[1].where("mode = 'read'")
    return use.groupBy("flow_id", "node_id").agg(F.array_join(F.array_sort(F.collect_list("variable_id")), ",").alias("reads"))
