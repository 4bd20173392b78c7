"""Changes between two versions of every flow (view W): a flow a customer, its orders before and after the cut as versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import changes as S
from flowlake.operators import diff as D
from flowlake.plans.registry import query
from flowlake.plans.views import CUT, M_SQL, manifest_pair, table

# Columns of the view in SQL that Spark and DuckDB both read; k is a number of a row, top a letter.
NODE = {
    "name": "concat('n', k % 3)", "source_type": "CASE WHEN k % 5 = 0 THEN 'Task' ELSE 'Menu' END", "tracking_id": "CASE WHEN k % 3 > 0 THEN k END",
    "support_level": "CASE k % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'opaque' WHEN 3 THEN 'unsupported' ELSE 'other' END",
    "expression": "CASE WHEN k % 6 > 0 THEN top END", "extra": "k % 2",
    "variable_writes": "CASE WHEN k % 2 = 0 THEN statuses END", "dependency_refs": "CASE WHEN k % 4 = 0 THEN statuses END", "prompt_refs": "CASE WHEN k % 5 > 1 THEN statuses END",
}
EDGE = {
    "edge_id": "concat(id, '#', CASE WHEN twin THEN 9 ELSE k % 2 END)", "src": "id", "dst": "CASE WHEN k % 7 = 0 THEN 'z' ELSE top END", "condition": "CASE WHEN k % 3 > 0 THEN concat('c', k % 3) END", "label": "concat('l', k % 4)",
    "role": "CASE left(id, 1) WHEN '1' THEN 'menu-choice' WHEN '2' THEN 'no-match' WHEN '3' THEN 'yes' WHEN '4' THEN 'next' ELSE 'default' END",
}
VARIABLE = {"name": "concat('v', k % 2)", "scope": "CASE WHEN k % 4 = 0 THEN 'flow' ELSE 'task' END", "data_type": "CASE WHEN k % 3 = 0 THEN 'integer' ELSE 'string' END", "direction": "CASE WHEN k % 5 = 0 THEN 'input' ELSE 'local' END", "secure": "k % 7 = 0", "read_node_ids": "statuses", "write_node_ids": "CASE WHEN k % 2 = 0 THEN statuses END"}
DEPENDENCY = {"type": "CASE WHEN k % 5 = 0 THEN 'oauthClient' ELSE 'queue' END", "display_name": "concat('d', k % 3)", "status": "top", "referenced_by": "statuses"}
FLOW = {
    "name": "concat('f', k % 2)", "description": "CASE WHEN k % 3 > 0 THEN concat('about ', k % 3) END", "type": "CASE WHEN k % 10 = 0 THEN 'bot' ELSE 'call' END", "secure": "k % 4 = 0", "division_id": "k % 2", "division_name": "CASE WHEN k % 2 = 0 THEN 'north' END",
    "languages": "CASE WHEN k % 5 > 1 THEN statuses END", "selected": "k", "state": "'published'", "published": "CASE WHEN k % 2 = 0 THEN k END", "latest_checked_in": "k % 3", "graph_hash": "k % 3",
}
WARNING = {"code": "CASE k % 4 WHEN 0 THEN 'ACTION_UNSUPPORTED' WHEN 1 THEN 'opaque-value' WHEN 2 THEN 'COVERAGE_LOW' ELSE 'EDGE_DANGLING' END", "severity": "CASE WHEN k % 2 = 0 THEN 'warning' ELSE 'info' END", "evidence_ids": "statuses"}


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


W_SQL = f"""
ver AS (SELECT o_custkey AS flow_id, o_orderpriority AS id, o_orderdate >= TIMESTAMP '{CUT}' AS later, CAST(sum(o_orderkey) AS BIGINT) AS k, list_sort(list(DISTINCT o_orderstatus)) AS statuses, max(o_orderstatus) AS top FROM orders GROUP BY ALL),
whole AS (SELECT o_custkey AS flow_id, o_orderdate >= TIMESTAMP '{CUT}' AS later, CAST(sum(o_orderkey) AS BIGINT) AS k, list_sort(list(DISTINCT o_orderstatus)) AS statuses, max(o_orderstatus) AS top FROM orders GROUP BY ALL),
wnode AS (SELECT flow_id, id AS node_id, later, {_list(NODE)}, top, statuses AS variable_reads FROM ver),
wedge AS (SELECT flow_id, later, {_list(EDGE)} FROM (SELECT *, FALSE AS twin FROM ver UNION ALL SELECT *, TRUE FROM ver WHERE k % 8 = 0)),
wvar AS (SELECT flow_id, id AS variable_id, later, {_list(VARIABLE)} FROM ver),
wdep AS (SELECT flow_id, id AS dependency_id, later, {_list(DEPENDENCY)} FROM ver),
wflow AS (SELECT flow_id, later, {_list(FLOW)} FROM whole),
wentry AS (SELECT flow_id, id AS node_id, later FROM ver WHERE k % 3 = 0),
wwarn AS (SELECT flow_id, later, {_list(WARNING)} FROM ver)"""


def versions(spark, d):
    """The collections of view W, each as (before, after)."""
    later = (F.col("o_orderdate") >= F.lit(CUT).cast("timestamp")).alias("later")
    facts = [F.sum("o_orderkey").alias("k"), F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"), F.max("o_orderstatus").alias("top")]
    orders = table(spark, d, "orders")
    ver = orders.groupBy(F.col("o_custkey").alias("flow_id"), F.col("o_orderpriority").alias("id"), later).agg(*facts)
    whole = orders.groupBy(F.col("o_custkey").alias("flow_id"), later).agg(*facts)
    pair = lambda df: (df.where("NOT later").drop("later"), df.where("later").drop("later"))
    of = lambda df, columns, *own: pair(df.select("flow_id", "later", *own, *(F.expr(v).alias(k) for k, v in columns.items())))
    node = ver.select("flow_id", "later", F.col("id").alias("node_id"), "top", F.col("statuses").alias("variable_reads"), *(F.expr(v).alias(k) for k, v in NODE.items()))
    settings = F.map_filter(F.create_map(F.lit("expression"), "expression", F.lit("extra"), F.col("extra").cast("string")), lambda _, v: v.isNotNull())
    node = node.withColumn("container_path", F.array("top", F.concat(F.lit("p"), F.col("extra").cast("string")))).withColumn("settings", settings)
    twins = ver.withColumn("twin", F.lit(False)).unionByName(ver.where("k % 8 = 0").withColumn("twin", F.lit(True)))
    return {
        "flow": of(whole, FLOW), "node": pair(node), "edge": of(twins, EDGE), "variable": of(ver, VARIABLE, F.col("id").alias("variable_id")),
        "dependency": of(ver, DEPENDENCY, F.col("id").alias("dependency_id")), "entry": pair(ver.where("k % 3 = 0").select("flow_id", "later", F.col("id").alias("node_id"))), "warning": of(ver, WARNING),
    }


def _fields(differing: dict[str, str]) -> str:
    return "concat_ws(','" + "".join(f", CASE WHEN {test} THEN '{f}' END" for f, test in differing.items()) + ")"


def _differ(*fields: str) -> dict[str, str]:
    return {f: f"b.{f} IS DISTINCT FROM a.{f}" for f in fields}


def _both(name: str, source: str, key: str, fields: str, more: str = "") -> str:
    """DuckDB: the two sides of a collection joined, its operation and changed fields."""
    return f"""{name}0 AS (SELECT coalesce(b.flow_id, a.flow_id) AS flow_id, coalesce(b.{key}, a.{key}) AS {key}, b.flow_id IS NOT NULL AS old, a.flow_id IS NOT NULL AS new, {fields} AS fields{more}
  FROM (FROM {source} WHERE NOT later) b FULL JOIN (FROM {source} WHERE later) a ON a.flow_id = b.flow_id AND a.{key} = b.{key}),
{name} AS (SELECT * REPLACE (CASE WHEN old AND new THEN fields ELSE '' END AS fields), CASE WHEN NOT old THEN 'added' WHEN NOT new THEN 'removed' WHEN fields <> '' THEN 'changed' ELSE 'same' END AS op FROM {name}0)"""


PATH = {"container_path": "b.top IS DISTINCT FROM a.top OR b.extra IS DISTINCT FROM a.extra"}
SETTINGS = {"settings": "b.expression IS DISTINCT FROM a.expression OR b.extra IS DISTINCT FROM a.extra"}
NODES = _both("nodes", "wnode", "node_id", _fields(_differ("name") | PATH | _differ("source_type", "support_level", "variable_reads", "variable_writes", "dependency_refs", "prompt_refs") | SETTINGS),
              ", b.expression IS DISTINCT FROM a.expression AS decided, CASE WHEN b.tracking_id IS NOT NULL AND a.tracking_id IS NOT NULL THEN 'trackingId' WHEN b.flow_id IS NULL OR a.flow_id IS NULL THEN 'unmatched' ELSE 'derivedIdentity' END AS basis, "
              "list_position(['unsupported', 'opaque', 'partial', 'full'], b.support_level) AS was, list_position(['unsupported', 'opaque', 'partial', 'full'], a.support_level) AS now")  # fmt: skip
VARIABLES = _both("vars", "wvar", "variable_id", _fields(_differ(*VARIABLE)), ", coalesce(b.secure, FALSE) OR coalesce(a.secure, FALSE) AS secure")
DEPENDENCIES = _both("deps", "wdep", "dependency_id", _fields(_differ(*DEPENDENCY)), ", coalesce(a.type, b.type) AS type")
EDGES = """gone AS (SELECT *, count(*) OVER (PARTITION BY flow_id, src, role) AS c FROM wedge b WHERE NOT later AND NOT EXISTS (FROM wedge a WHERE a.later AND a.flow_id = b.flow_id AND a.edge_id = b.edge_id)),
came AS (SELECT *, count(*) OVER (PARTITION BY flow_id, src, role) AS c FROM wedge a WHERE later AND NOT EXISTS (FROM wedge b WHERE NOT b.later AND a.flow_id = b.flow_id AND a.edge_id = b.edge_id)),
moved AS (SELECT a.flow_id, b.edge_id AS before_id, a.edge_id AS after_id, a.src, a.role, 'changed' AS op, concat_ws(',', CASE WHEN a.dst IS DISTINCT FROM b.dst THEN 'dst' END, CASE WHEN a.condition IS DISTINCT FROM b.condition THEN 'condition' END, CASE WHEN a.label IS DISTINCT FROM b.label THEN 'label' END) AS fields
  FROM gone b JOIN came a ON a.flow_id = b.flow_id AND a.src = b.src AND a.role = b.role WHERE a.c = 1 AND b.c = 1),
edges AS (FROM moved UNION ALL SELECT a.flow_id, b.edge_id, a.edge_id, a.src, a.role, 'changed', 'label' FROM wedge b JOIN wedge a ON a.flow_id = b.flow_id AND a.edge_id = b.edge_id AND a.later AND NOT b.later WHERE a.label IS DISTINCT FROM b.label
  UNION ALL SELECT flow_id, edge_id, NULL, src, role, 'removed', '' FROM gone g WHERE NOT EXISTS (FROM moved m WHERE m.flow_id = g.flow_id AND m.before_id = g.edge_id)
  UNION ALL SELECT flow_id, NULL, edge_id, src, role, 'added', '' FROM came g WHERE NOT EXISTS (FROM moved m WHERE m.flow_id = g.flow_id AND m.after_id = g.edge_id))"""


def _text(df):
    return df.withColumn("fields", F.array_join("fields", ","))


@query(f"WITH {W_SQL}, {NODES} SELECT flow_id, node_id, op, fields, basis FROM nodes")
def d2_node_fields(spark, d):
    return _text(S.node_changes(*versions(spark, d)["node"])).select("flow_id", "node_id", "op", "fields", "basis")


@query(f"WITH {W_SQL}, {EDGES} SELECT flow_id, before_id, after_id, src, role, op, fields FROM edges")
def d3_diff_edges(spark, d):
    return _text(S.edge_changes(*versions(spark, d)["edge"]))


@query(f"WITH {W_SQL}, {VARIABLES} SELECT flow_id, variable_id, op, fields, secure FROM vars")
def d4_diff_variables(spark, d):
    return _text(S.variable_changes(*versions(spark, d)["variable"])).select("flow_id", "variable_id", "op", "fields", "secure")


@query(f"WITH {W_SQL}, {DEPENDENCIES} SELECT flow_id, dependency_id, op, fields, type FROM deps")
def d5_diff_dependencies(spark, d):
    return _text(S.dependency_changes(*versions(spark, d)["dependency"])).select("flow_id", "dependency_id", "op", "fields", "type")


FLOW_TESTS = {c: f"{c} IS DISTINCT FROM a.{c}" for c in ("name", "description", "type", "secure", "division_id", "division_name")}
CHANGES = f"""{NODES}, {VARIABLES}, {DEPENDENCIES}, {EDGES},
fpair AS (SELECT b.flow_id, [{", ".join(f"CASE WHEN b.{t} THEN '{c}' END" for c, t in FLOW_TESTS.items())}] AS meta, coalesce(b.languages, []) <> coalesce(a.languages, []) AS spoken,
  (b.selected <> a.selected OR b.published IS DISTINCT FROM a.published OR b.latest_checked_in <> a.latest_checked_in) AND b.graph_hash = a.graph_hash AS only_version FROM wflow b JOIN wflow a ON a.flow_id = b.flow_id AND a.later AND NOT b.later),
epair AS (SELECT coalesce(b.flow_id, a.flow_id) AS flow_id, coalesce(b.node_id, a.node_id) AS node_id, b.flow_id IS NOT NULL AS had, a.flow_id IS NOT NULL AS has FROM (FROM wentry WHERE NOT later) b FULL JOIN (FROM wentry WHERE later) a ON a.flow_id = b.flow_id AND a.node_id = b.node_id),
evt AS (SELECT e.*, had AND has AND n.basis <> 'unmatched' AS still FROM epair e LEFT JOIN nodes n ON n.flow_id = e.flow_id AND n.node_id = e.node_id),
change AS (
  SELECT flow_id, 'flow-metadata-changed' AS category, 'changed' AS operation, f AS subject, NULL AS aspect, f AS field, NULL::BOOLEAN AS secure, NULL AS dependency_type, NULL AS direction FROM (SELECT flow_id, unnest(meta) AS f FROM fpair) WHERE f IS NOT NULL
  UNION ALL SELECT flow_id, 'prompt-reference-changed', 'changed', 'flow-languages', NULL, NULL, NULL, NULL, NULL FROM fpair WHERE spoken
  UNION ALL SELECT flow_id, 'published-version-only-changed', 'changed', NULL, NULL, NULL, NULL, NULL, NULL FROM fpair WHERE only_version
  UNION ALL SELECT flow_id, 'entry-point-changed', 'added', node_id, NULL, NULL, NULL, NULL, NULL FROM evt WHERE has AND NOT still
  UNION ALL SELECT flow_id, 'entry-point-changed', 'removed', node_id, NULL, NULL, NULL, NULL, NULL FROM evt WHERE had AND NOT still
  UNION ALL SELECT flow_id, 'action-changed', op, node_id, 'presence', NULL, NULL, NULL, NULL FROM nodes WHERE op IN ('added', 'removed')
  UNION ALL SELECT flow_id, 'prompt-reference-changed', 'changed', node_id, NULL, NULL, NULL, NULL, NULL FROM nodes WHERE op = 'changed' AND contains(fields, 'prompt_refs')
  UNION ALL SELECT flow_id, 'coverage-changed', 'changed', node_id, NULL, NULL, NULL, NULL, CASE WHEN now < was THEN 'regressed' ELSE 'improved' END FROM nodes WHERE op = 'changed' AND now <> was
  UNION ALL SELECT flow_id, CASE WHEN decided THEN 'condition-expression-changed' ELSE 'action-changed' END, 'changed', node_id, CASE WHEN NOT decided THEN 'reconfigured' END, NULL, NULL, NULL, NULL FROM nodes WHERE op = 'changed' AND contains(fields, 'settings')
  UNION ALL SELECT flow_id, 'action-changed', 'changed', node_id, CASE WHEN list_has_any(rest, ['source_type', 'variable_reads', 'variable_writes', 'dependency_refs', 'prompt_refs']) THEN 'reconfigured' ELSE 'relabeled' END, NULL, NULL, NULL, NULL
    FROM (SELECT *, list_filter(string_split(fields, ','), lambda f: f NOT IN ('', 'support_level', 'settings')) AS rest FROM nodes WHERE op = 'changed') WHERE len(rest) > 0
  UNION ALL SELECT flow_id, CASE WHEN role = 'menu-choice' THEN 'menu-choice-changed' WHEN role = 'no-match' THEN 'outcome-path-changed' WHEN role IN ('yes', 'default') AND op = 'changed' AND contains(fields, 'condition') THEN 'condition-expression-changed' ELSE 'action-changed' END, op, src,
    CASE WHEN role = 'menu-choice' THEN CASE WHEN op <> 'changed' THEN 'presence' WHEN contains(fields, 'dst') THEN 'route' ELSE 'label' END WHEN role = 'no-match' THEN role
      WHEN role = 'next' THEN CASE WHEN op <> 'changed' OR contains(fields, 'dst') THEN 'position' ELSE 'relabeled' END WHEN op <> 'changed' THEN 'reconfigured' WHEN contains(fields, 'condition') THEN NULL WHEN contains(fields, 'dst') THEN 'reconfigured' ELSE 'relabeled' END, NULL, NULL, NULL, NULL FROM edges
  UNION ALL SELECT flow_id, 'variable-changed', op, variable_id, CASE WHEN op <> 'changed' THEN 'presence' WHEN contains(fields, 'data_type') THEN 'type' ELSE 'usage-location' END, NULL, secure, NULL, NULL FROM vars WHERE op <> 'same'
  UNION ALL SELECT flow_id, 'dependency-changed', op, dependency_id, CASE WHEN op <> 'changed' THEN 'presence' WHEN contains(fields, 'status') THEN 'resolution' WHEN contains(fields, 'referenced_by') THEN 'reference' ELSE 'displayName' END, NULL, NULL, type, NULL FROM deps WHERE op <> 'same'
  UNION ALL SELECT flow_id, 'coverage-changed', 'added', NULL, NULL, NULL, NULL, NULL, 'regressed' FROM wwarn a WHERE later AND code <> 'EDGE_DANGLING' AND NOT EXISTS (FROM wwarn b WHERE NOT b.later AND b.flow_id = a.flow_id AND b.code = a.code AND b.severity = a.severity AND b.evidence_ids = a.evidence_ids))"""


@query(f"WITH {W_SQL}, {CHANGES} SELECT * FROM change")
def d7_semantic_changes(spark, d):
    return S.semantic_changes(**versions(spark, d))


@query(f"""WITH {W_SQL}, {CHANGES}, r AS (SELECT flow_id, CASE WHEN category = 'flow-metadata-changed' AND field = 'secure' OR category = 'variable-changed' AND secure OR category = 'dependency-changed' AND dependency_type = 'oauthClient' THEN 5 WHEN category = 'coverage-changed' AND direction = 'regressed' THEN 6
  WHEN category = 'dependency-changed' THEN 4 WHEN category = 'flow-metadata-changed' OR category = 'menu-choice-changed' AND aspect = 'label' OR category = 'action-changed' AND aspect = 'relabeled' THEN 1
  WHEN category IN ('prompt-reference-changed', 'published-version-only-changed', 'coverage-changed') THEN 2 ELSE 3 END AS rank FROM change)
SELECT c_custkey AS flow_id, count(*) FILTER (rank = 5) AS security_sensitive, count(*) FILTER (rank = 6) AS coverage_regression, ['light-review', 'automated-plus-spot-check', 'human-review-required', 'engineer-review-required', 'security-lead-review', 'blocked'][coalesce(max(rank), 2)] AS highest_review FROM customer LEFT JOIN r ON r.flow_id = c_custkey GROUP BY ALL""")
def d9_review_of_versions(spark, d):
    """The semantic changes of every flow, classified."""
    rows = D.classify(S.semantic_changes(**versions(spark, d)), table(spark, d, "customer").select(F.col("c_custkey").alias("flow_id")))
    return rows.select("flow_id", "security_sensitive", "coverage_regression", "highest_review")


@query("SELECT event_id, event_type <> 'error' AS coverage FROM events")
def p8_coverage_warning(spark, d):
    kind = F.col("event_type")
    code = F.when(kind == "view", "ACTION_UNSUPPORTED").when(kind == "click", "value-opaque").when(kind == "error", "EDGE_DANGLING").otherwise("Coverage")
    return table(spark, d, "events").select("event_id", S.coverage_warning(code).alias("coverage"))


@query(f"""WITH {M_SQL} SELECT p.flow_id, CASE WHEN p.flow_id % 3 = 0 THEN 'out-of-scope' WHEN n.status = 'forbidden' THEN 'inaccessible' ELSE 'retire-candidate' END AS reason
  FROM previous p LEFT JOIN discovered n USING (flow_id) WHERE n.status IS DISTINCT FROM 'found'""")
def j9_absent_flows(spark, d):
    previous, found = manifest_pair(spark, d)
    return S.absent_flows(previous, found, table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("flow_id")))
