"""Graph, snapshot and catalogue views over the driver tables, each with its DuckDB text.

E: one control graph a user (nodes are event types, edges are transitions seen at least four times); O: a pair of
snapshots a customer; M: manifest and discovery; R: resource graph by foreign keys; V: variables; K: claims; P: catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUT = "1998-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows that grow into documents, dealt by their key first: a small file is read by few tasks, its documents are many times its size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# --- E: control graphs -------------------------------------------------------------------------------------------
E_SQL = """
trans AS (SELECT user_id AS flow_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
edge AS (SELECT flow_id, src || '->' || dst AS edge_id, src, dst,
  CASE WHEN dst = 'click' THEN 'menu-choice' WHEN dst = 'error' THEN 'failure' ELSE 'next' END AS role, CASE WHEN dst IN ('click', 'error') THEN 'on ' || dst END AS label, count(*) AS n
  FROM trans WHERE dst IS NOT NULL AND NOT (dst = 'signup' AND flow_id % 5 = 0) GROUP BY flow_id, src, dst HAVING count(*) >= 4),
node AS (SELECT user_id AS flow_id, event_type AS node_id, 'step ' || event_type AS name,
  CASE WHEN event_type = 'purchase' AND user_id % 4 = 0 THEN 'TransferTaskAction' WHEN event_type = 'purchase' THEN 'TransferAction' WHEN event_type = 'signup' AND user_id % 7 = 0 THEN 'DisconnectLaterAction' WHEN event_type = 'signup' THEN 'DisconnectAction' ELSE 'PlayAction' END AS source_type,
  CASE WHEN event_type = 'view' THEN 'partial' ELSE 'full' END AS support_level, min(event_id) AS ord
  FROM events WHERE NOT (event_type = 'error' AND user_id % 3 = 0) GROUP BY user_id, event_type),
entry AS (SELECT user_id AS flow_id, arg_min(event_type, event_id) AS node_id FROM events GROUP BY user_id)"""


def control_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """node, edge and entry of every flow."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.col("user_id").alias("flow_id"))
    steps = events.withColumn("dst", F.lead("event_type").over(Window.partitionBy("flow_id").orderBy("ts", "event_id")))
    steps = steps.where(F.col("dst").isNotNull() & ~((F.col("dst") == "signup") & (F.col("flow_id") % 5 == 0)))
    edge = steps.groupBy("flow_id", F.col("event_type").alias("src"), "dst").agg(F.count("*").alias("n")).where("n >= 4")
    role = F.when(F.col("dst") == "click", "menu-choice").when(F.col("dst") == "error", "failure").otherwise("next")
    label = F.when(F.col("dst").isin("click", "error"), F.concat(F.lit("on "), "dst"))
    edge = edge.select("flow_id", F.concat("src", F.lit("->"), "dst").alias("edge_id"), "src", "dst", role.alias("role"), label.alias("label"), "n")
    kept = events.where(~((F.col("event_type") == "error") & (F.col("flow_id") % 3 == 0)))
    node = kept.groupBy("flow_id", F.col("event_type").alias("node_id")).agg(F.min("event_id").alias("ord"))
    bought, signed = F.col("node_id") == "purchase", F.col("node_id") == "signup"
    kind = F.when(bought & (F.col("flow_id") % 4 == 0), "TransferTaskAction").when(bought, "TransferAction")
    kind = kind.when(signed & (F.col("flow_id") % 7 == 0), "DisconnectLaterAction").when(signed, "DisconnectAction").otherwise("PlayAction")
    level = F.when(F.col("node_id") == "view", "partial").otherwise("full")
    node = node.select("flow_id", "node_id", F.concat(F.lit("step "), "node_id").alias("name"), kind.alias("source_type"), level.alias("support_level"), "ord")
    entry = events.groupBy("flow_id").agg(F.min_by("event_type", "event_id").alias("node_id"))
    return node, edge, entry


# --- O: snapshot pairs -------------------------------------------------------------------------------------------
O_SQL = f"""
snap AS (SELECT o_custkey AS flow_id, o_orderpriority AS node_id, o_orderdate >= TIMESTAMP '{CUT}' AS after, count(*) AS n,
  list_sort(list(DISTINCT o_orderstatus)) AS statuses, max(o_orderstatus) AS top FROM orders GROUP BY ALL),
before AS (SELECT * EXCLUDE (after) FROM snap WHERE NOT after), later AS (SELECT * EXCLUDE (after) FROM snap WHERE after)"""


def snapshot_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")

    def side(rows: DataFrame) -> DataFrame:
        group = rows.groupBy(F.col("o_custkey").alias("flow_id"), F.col("o_orderpriority").alias("node_id"))
        return group.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"), F.max("o_orderstatus").alias("top"))

    cut = F.lit(CUT).cast("timestamp")
    return side(orders.where(F.col("o_orderdate") < cut)), side(orders.where(F.col("o_orderdate") >= cut))


# --- M: manifest and discovery -----------------------------------------------------------------------------------
M_SQL = f"""
ranked AS (SELECT o_custkey AS flow_id, o_orderkey AS version, o_orderpriority AS division, o_orderstatus AS hash, o_orderdate < TIMESTAMP '{CUT}' AS old,
  row_number() OVER (PARTITION BY o_custkey, o_orderdate < TIMESTAMP '{CUT}' ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders),
previous AS (SELECT flow_id, version, division, hash FROM ranked WHERE old AND r = 1),
fresh AS (SELECT flow_id, version, division, hash FROM ranked WHERE NOT old AND r = 1),
discovered AS (SELECT c_custkey AS flow_id, CASE WHEN c_nationkey = 7 THEN 'forbidden' WHEN f.flow_id IS NULL AND c_custkey % 2 = 0 THEN 'not-found' ELSE 'found' END AS status,
  CASE WHEN f.flow_id IS NULL THEN p.version ELSE f.version END AS version, CASE WHEN f.flow_id IS NULL THEN p.division ELSE f.division END AS division,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN f.flow_id IS NULL THEN p.hash ELSE f.hash END AS hash
  FROM customer LEFT JOIN fresh f ON f.flow_id = c_custkey LEFT JOIN previous p ON p.flow_id = c_custkey WHERE c_custkey % 13 <> 0)"""


def manifest_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """previous and discovered, one row a flow."""
    orders = table(spark, sf_dir, "orders")
    latest = Window.partitionBy("flow_id").orderBy(F.desc("o_orderdate"), F.desc("version"))
    cut = F.lit(CUT).cast("timestamp")

    def last(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("o_custkey").alias("flow_id"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("division"), F.col("o_orderstatus").alias("hash"), "o_orderdate")
        return rows.withColumn("r", F.row_number().over(latest)).where("r = 1").drop("r", "o_orderdate")

    previous, fresh = last(orders.where(F.col("o_orderdate") < cut)), last(orders.where(F.col("o_orderdate") >= cut))
    flows = table(spark, sf_dir, "customer").where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("flow_id"), "c_nationkey")
    rows = flows.join(fresh.withColumn("new", F.lit(True)), "flow_id", "left")
    old = previous.select("flow_id", *(F.col(c).alias(f"p_{c}") for c in ("version", "division", "hash")))
    rows = rows.join(old, "flow_id", "left")
    status = F.when(F.col("c_nationkey") == 7, "forbidden").when(F.col("new").isNull() & (F.col("flow_id") % 2 == 0), "not-found").otherwise("found")
    pick = {c: F.when(F.col("new").isNull(), F.col(f"p_{c}")).otherwise(F.col(c)) for c in ("version", "division", "hash")}
    pick["hash"] = F.when(F.col("flow_id") % 11 != 0, pick["hash"])
    return previous, rows.select("flow_id", status.alias("status"), *(v.alias(k) for k, v in pick.items()))


# --- R: resource graph -------------------------------------------------------------------------------------------
R_SQL = """
rnode AS (SELECT 'order:' || o_orderkey AS key, 'order' AS type FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'customer' FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation WHERE n_nationkey % 8 <> 0 UNION ALL SELECT 'region:' || r_regionkey, 'region' FROM region
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier),
redge AS (SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst, 'o_custkey' AS via FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'c_nationkey' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 's_nationkey' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'n_regionkey' FROM nation WHERE n_nationkey % 8 <> 0)"""


def resource_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """node(key, type) and edge(src, dst, via); nations with key % 8 = 0 are missing as nodes."""
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region", "supplier")}
    t["nation"] = t["nation"].where("n_nationkey % 8 <> 0")
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    ids = {"orders": ("order", "o_orderkey"), "customer": ("customer", "c_custkey"), "nation": ("nation", "n_nationkey"), "region": ("region", "r_regionkey"), "supplier": ("supplier", "s_suppkey")}
    refs = [("orders", "customer", "o_custkey"), ("customer", "nation", "c_nationkey"), ("supplier", "nation", "s_nationkey"), ("nation", "region", "n_regionkey")]
    nodes = [t[n].select(key(kind, c).alias("key"), F.lit(kind).alias("type")) for n, (kind, c) in ids.items()]
    edges = [t[n].select(key(*ids[n]).alias("src"), key(kind, c).alias("dst"), F.lit(c).alias("via")) for n, kind, c in refs]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(nodes), union(edges)


# --- V: variables ------------------------------------------------------------------------------------------------
V_SQL = """
variable AS (SELECT DISTINCT l_suppkey AS flow_id, l_partkey AS variable_id FROM lineitem),
variable_use AS (SELECT DISTINCT l_suppkey AS flow_id, l_partkey AS variable_id, l_orderkey AS node_id, CASE l_returnflag WHEN 'R' THEN 'read' ELSE 'write' END AS mode
  FROM lineitem WHERE l_returnflag IN ('R', 'A'))"""


def variables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """variable and variable_use."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("flow_id"), F.col("l_partkey").alias("variable_id"), F.col("l_orderkey").alias("node_id"), "l_returnflag")
    mode = F.when(F.col("l_returnflag") == "R", "read").otherwise("write")
    use = lines.where(F.col("l_returnflag").isin("R", "A")).select("flow_id", "variable_id", "node_id", mode.alias("mode")).distinct()
    return lines.select("flow_id", "variable_id").distinct(), use


# --- P: catalogue ------------------------------------------------------------------------------------------------
P_SQL = """
flow AS (SELECT c_custkey AS flow_id, right(c_name, 2) AS name, c_mktsegment AS type, c_nationkey AS division_id,
  CASE WHEN c_acctbal > 0 THEN CAST(round(c_acctbal) AS BIGINT) END AS published_version FROM customer)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    version = F.when(F.col("c_acctbal") > 0, F.round("c_acctbal").cast("long"))
    return c.select(F.col("c_custkey").alias("flow_id"), F.right("c_name", F.lit(2)).alias("name"), F.col("c_mktsegment").alias("type"), F.col("c_nationkey").alias("division_id"), version.alias("published_version"))


# --- S: flows of some hundred nodes ------------------------------------------------------------------------------
# A supplier's lines in order: 110 runs of four, closed and open in turn, then one long cycle.
S_SQL = """
line AS (SELECT l_suppkey AS flow_id, l_orderkey, l_partkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1 AS rn FROM lineitem),
sized AS (SELECT *, count(*) OVER (PARTITION BY flow_id) AS n FROM line),
flow AS (SELECT DISTINCT flow_id, 'Flow ' || flow_id AS name, 'inboundcall' AS type, CASE WHEN flow_id % 4 = 0 THEN repeat('long ', 300) WHEN flow_id % 2 = 0 THEN 'about ' || flow_id END AS description FROM line),
node AS (SELECT flow_id, 'n' || lpad(CAST(rn AS VARCHAR), 9, '0') AS node_id, 'Step ' || l_orderkey AS name, CASE l_returnflag WHEN 'R' THEN 'DataAction' WHEN 'A' THEN 'PlayAudioAction' ELSE 'DecisionAction' END AS source_type,
  '/flowSequenceItemList/0/actionList/' || rn AS pointer, rn, n, l_orderkey, l_partkey, l_returnflag, l_linestatus FROM sized),
step AS (SELECT flow_id, rn, rn + 1 AS to_rn, 'next' AS role FROM sized WHERE rn + 1 < n AND (rn >= 440 OR rn % 4 < 3)
  UNION ALL SELECT flow_id, rn, rn - 3, 'loop' FROM sized WHERE rn < 440 AND rn % 8 = 3 UNION ALL SELECT flow_id, rn, 440, 'loop' FROM sized WHERE rn + 1 = n AND rn > 440
  UNION ALL SELECT flow_id, rn, 1000000 + rn, 'failure' FROM sized WHERE rn % 50 = 0),
edge AS (SELECT flow_id, 'n' || lpad(CAST(rn AS VARCHAR), 9, '0') AS src, 'n' || lpad(CAST(to_rn AS VARCHAR), 9, '0') AS dst, role FROM step),
entry AS (SELECT flow_id, node_id FROM node WHERE rn = 0 OR rn < 440 AND rn % 8 = 4),
variable AS (SELECT flow_id, variable_id, 'var ' || variable_id AS name, 'flow' AS scope, l_partkey % 10 = 0 AS secure, '/variables/' || (row_number() OVER (PARTITION BY flow_id ORDER BY variable_id) - 1) AS pointer
  FROM (SELECT DISTINCT flow_id, 'v' || l_partkey || l_linestatus AS variable_id, l_partkey FROM line)),
dependency AS (SELECT flow_id, dependency_id, type, CASE WHEN l_orderkey % 7 <> 0 THEN 'Dep ' || l_orderkey END AS display_name, CASE WHEN l_orderkey % 5 = 0 THEN 'not-found' ELSE 'resolved' END AS status,
  '/manifest/' || type || '/' || (row_number() OVER (PARTITION BY flow_id, type ORDER BY dependency_id) - 1) AS pointer
  FROM (SELECT DISTINCT flow_id, 'd' || l_orderkey AS dependency_id, l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN 'dataAction' WHEN 1 THEN 'queue' ELSE 'userPrompt' END AS type FROM line))"""


def supplier_flows(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """flow, node, edge, entry, variable, use and dependency."""
    order = Window.partitionBy("flow_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("flow_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    line = spread(line, "flow_id")  # all that is made of a flow's lines stays with them
    line = line.withColumn("rn", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("flow_id")))
    text = lambda c: F.col(c).cast("string")
    node_id = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("string"), 9, "0"))
    flow_id, rn = F.col("flow_id"), F.col("rn")
    about = F.when(flow_id % 4 == 0, F.repeat(F.lit("long "), F.lit(300))).when(flow_id % 2 == 0, F.concat(F.lit("about "), text("flow_id")))
    flow = line.select("flow_id").distinct().select("flow_id", F.concat(F.lit("Flow "), text("flow_id")).alias("name"), F.lit("inboundcall").alias("type"), about.alias("description"))
    kind = F.when(F.col("l_returnflag") == "R", "DataAction").when(F.col("l_returnflag") == "A", "PlayAudioAction").otherwise("DecisionAction")
    node = line.select("flow_id", node_id(rn).alias("node_id"), F.concat(F.lit("Step "), text("l_orderkey")).alias("name"), kind.alias("source_type"), F.concat(F.lit("/flowSequenceItemList/0/actionList/"), text("rn")).alias("pointer"), "rn", "l_partkey")
    step = lambda on, to, role: F.when(on, F.struct(to.cast("int").alias("to"), F.lit(role).alias("role")))
    steps = F.array_compact(F.array(
        step((rn + 1 < F.col("n")) & ((rn >= 440) | (rn % 4 < 3)), rn + 1, "next"), step((rn < 440) & (rn % 8 == 3), rn - 3, "loop"),
        step((rn + 1 == F.col("n")) & (rn > 440), F.lit(440), "loop"), step(rn % 50 == 0, rn + 1000000, "failure"),
    ))
    edge = line.select("flow_id", "rn", F.explode(steps).alias("s")).select("flow_id", node_id(rn).alias("src"), node_id(F.col("s.to")).alias("dst"), "s.role")
    entry = node.where((rn == 0) | ((rn < 440) & (rn % 8 == 4))).select("flow_id", "node_id")
    var = F.concat(F.lit("v"), text("l_partkey"), "l_linestatus")
    at = lambda *keys: (F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])) - 1).cast("string")
    variable = line.select("flow_id", var.alias("variable_id"), "l_partkey").distinct()
    variable = variable.select("flow_id", "variable_id", F.concat(F.lit("var "), "variable_id").alias("name"), F.lit("flow").alias("scope"), (F.col("l_partkey") % 10 == 0).alias("secure"), F.concat(F.lit("/variables/"), at("flow_id", "variable_id")).alias("pointer"))
    mode = F.when(F.col("l_returnflag") == "R", "read").otherwise("write")
    use = line.where(F.col("l_returnflag").isin("R", "A")).select("flow_id", var.alias("variable_id"), node_id(rn).alias("node_id"), mode.alias("mode"))
    key = F.col("l_orderkey")
    dep = line.select("flow_id", F.concat(F.lit("d"), text("l_orderkey")).alias("dependency_id"), "l_orderkey", F.when(key % 3 == 0, "dataAction").when(key % 3 == 1, "queue").otherwise("userPrompt").alias("type")).distinct()
    dep = dep.select("flow_id", "dependency_id", "type", F.when(key % 7 != 0, F.concat(F.lit("Dep "), text("l_orderkey"))).alias("display_name"), F.when(key % 5 == 0, "not-found").otherwise("resolved").alias("status"), F.concat(F.lit("/manifest/"), "type", F.lit("/"), at("flow_id", "type", "dependency_id")).alias("pointer"))
    return {"flow": flow, "node": node.drop("rn"), "edge": edge, "entry": entry, "variable": variable, "use": use, "dependency": dep}
