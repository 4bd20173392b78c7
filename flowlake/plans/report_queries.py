"""Claims, integrity, aggregation and report queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlake.functions import text as X
from flowlake.operators import diff as D
from flowlake.operators import graph as G
from flowlake.operators import grounding as V
from flowlake.operators import quality as I
from flowlake.operators import resources as R
from flowlake.plans.graph_queries import GRAPH, KIND
from flowlake.plans.registry import query
from flowlake.plans.snapshot_queries import forbid_sql
from flowlake.plans.views import M_SQL, O_SQL, P_SQL, R_SQL, V_SQL, catalogue, control_graph, manifest_pair, resource_graph, snapshot_pair, table, variables

# ---------------------------------------------------------------- claims (view K)
K_SQL = """
evidence AS (SELECT conv_id AS flow_id, turn AS evidence_id, text FROM conversations),
said AS (SELECT conv_id AS flow_id, turn AS claim_idx, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
claim AS (SELECT flow_id, claim_idx, text, ['overview', 'journeys', 'decisions', 'dependencies', 'risks', 'operations', 'unknowns', 'appendix'][claim_idx % 8 + 1] AS section_id,
  ['fact', 'derived', 'inference', 'unknown'][claim_idx % 4 + 1] AS kind, CASE WHEN claim_idx % 5 = 0 THEN -1 WHEN claim_idx % 9 = 0 THEN NULL ELSE claim_idx - 1 END AS evidence_id,
  CASE WHEN claim_idx % 7 = 0 THEN 'made up' ELSE left(prev, 40) END AS quote FROM said WHERE role = 'assistant')"""
FAIL = f"""CASE WHEN c.text IS NULL OR length(trim(c.text)) = 0 THEN 'malformed' WHEN length(c.text) > 500 THEN 'too-large' WHEN ({forbid_sql('c.text')}) IS NOT NULL THEN 'forbidden-pattern'
  WHEN length(quote) > 120 THEN 'quotation-too-long' WHEN quote IS NOT NULL AND NOT EXISTS (FROM evidence q WHERE q.flow_id = c.flow_id AND contains(q.text, quote)) THEN 'quotation-not-in-corpus' WHEN c.evidence_id IS NOT NULL AND e.evidence_id IS NULL THEN 'unknown-evidence'
  WHEN c.evidence_id IS NULL AND kind <> 'unknown' THEN 'no-evidence' WHEN kind = 'inference' THEN 'inference-not-allowed' END"""
CHECKED = f"WITH {K_SQL}, checked AS (SELECT c.flow_id, claim_idx, section_id, {FAIL} AS failure, length(c.text) AS n FROM claim c LEFT JOIN evidence e ON e.flow_id = c.flow_id AND e.evidence_id = c.evidence_id)"


def _claims(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("flow_id"), F.col("turn").alias("claim_idx"), "role", "text")
    rows = rows.withColumn("prev", F.lag("text").over(Window.partitionBy("flow_id").orderBy("claim_idx"))).where("role = 'assistant'")
    pick = lambda names, m: F.element_at(F.array(*map(F.lit, names)), (F.col("claim_idx") % m + 1).cast("int"))
    evidence_id = F.when(F.col("claim_idx") % 5 == 0, F.lit(-1).cast("long")).when(F.col("claim_idx") % 9 == 0, None).otherwise(F.col("claim_idx") - 1)
    quote = F.when(F.col("claim_idx") % 7 == 0, "made up").otherwise(F.left("prev", F.lit(40)))
    claim = rows.select("flow_id", "claim_idx", "text", pick([*V.SECTIONS, "appendix"], 8).alias("section_id"), pick(["fact", "derived", "inference", "unknown"], 4).alias("kind"), evidence_id.alias("evidence_id"), quote.alias("quote"))
    evidence = table(spark, d, "conversations").select(F.col("conv_id").alias("flow_id"), F.col("turn").alias("evidence_id"), "text")
    return claim, evidence


@query(CHECKED + " SELECT flow_id, claim_idx, failure FROM checked")
def v5_validate_claims(spark, d):
    return V.validate_claims(*_claims(spark, d)).select("flow_id", "claim_idx", "failure")


@query(CHECKED + " SELECT DISTINCT flow_id, section_id FROM checked WHERE section_id = 'appendix'")
def v6_section_gate(spark, d):
    return V.section_gate(_claims(spark, d)[0])[1].select("flow_id", "section_id")


@query(CHECKED + " SELECT coalesce(failure, 'accepted') AS outcome, count(*) AS claims FROM checked GROUP BY ALL")
def v10_grounding_report(spark, d):
    return V.grounding_report(V.validate_claims(*_claims(spark, d)))


@query(f"""WITH RECURSIVE {K_SQL}, i AS (SELECT flow_id, claim_idx, length(text) AS n, row_number() OVER (PARTITION BY flow_id ORDER BY claim_idx) AS r FROM claim),
fold AS (SELECT flow_id, 0::BIGINT AS r, 0::BIGINT AS used, 0 AS k, FALSE AS kept, NULL::BIGINT AS claim_idx FROM (SELECT DISTINCT flow_id FROM i)
  UNION ALL SELECT f.flow_id, i.r, CASE WHEN k < 3 AND used + n <= 1500 THEN used + n ELSE used END, CASE WHEN k < 3 AND used + n <= 1500 THEN k + 1 ELSE k END, k < 3 AND used + n <= 1500, i.claim_idx
  FROM fold f JOIN i ON i.flow_id = f.flow_id AND i.r = f.r + 1)
SELECT flow_id, claim_idx, kept FROM fold WHERE r > 0""")
def v7_section_budget(spark, d):
    claim = _claims(spark, d)[0].withColumn("n", F.length("text"))
    return V.greedy_budget(claim, ["flow_id"], "claim_idx", "n", 3, 1500).select("flow_id", "claim_idx", "kept")


@query(f"WITH {K_SQL}, r AS (SELECT flow_id, count(*) AS n FROM claim GROUP BY ALL) SELECT flow_id, n - 2 AS omitted FROM r WHERE n > 2")
def v1_evidence_pack_truncation(spark, d):
    return V.cap_with_record(_claims(spark, d)[0], ["flow_id"], ["claim_idx"], 2)[1]


@query(f"WITH {K_SQL} SELECT flow_id, count(DISTINCT evidence_id) FILTER (EXISTS (FROM evidence e WHERE e.flow_id = c.flow_id AND e.evidence_id = c.evidence_id)) AS cited, count(*) FILTER (evidence_id IS NOT NULL AND NOT EXISTS (FROM evidence e WHERE e.flow_id = c.flow_id AND e.evidence_id = c.evidence_id)) AS dropped FROM claim c GROUP BY ALL")
def v2_pack_evidence_ids(spark, d):
    claim, evidence = _claims(spark, d)
    rows = claim.join(evidence.select("flow_id", "evidence_id", F.lit(True).alias("known")), ["flow_id", "evidence_id"], "left")
    return rows.groupBy("flow_id").agg(F.countDistinct(F.when(F.col("known"), F.col("evidence_id"))).alias("cited"), F.count_if(F.col("evidence_id").isNotNull() & F.col("known").isNull()).alias("dropped"))


# ---------------------------------------------------------------- integrity
@query("SELECT CAST(c_custkey AS VARCHAR) AS key, rule FROM (SELECT c_custkey, unnest([CASE WHEN NOT coalesce(c_acctbal >= 0, FALSE) THEN 'balance' END, CASE WHEN NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'), FALSE) THEN 'segment' END, CASE WHEN NOT coalesce(regexp_matches(c_name, '^Customer#[0-9]{8}[02468]$'), FALSE) THEN 'name' END]) AS rule FROM customer) WHERE rule IS NOT NULL")
def q8_schema_validate(spark, d):
    rules = {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), "name": F.rlike("c_name", F.lit("^Customer#[0-9]{8}[02468]$"))}
    return I.schema_validate(table(spark, d, "customer"), "c_custkey", rules)


@query("SELECT * FROM (VALUES ('customer', 'COUNTS_MISMATCH'), ('gone', 'FILE_MISSING'), ('orders', 'MANIFEST_MISSING'), ('supplier', 'CONTENT_HASH_MISMATCH')) AS t(\"table\", finding)")
def q7_verify_bundle(spark, d):
    """The tables against a manifest made from them, with a wrong count, a wrong hash, a missing and an extra entry."""
    tables = {n: table(spark, d, n) for n in ("customer", "nation", "orders", "supplier")}
    made = I.table_hash(tables["nation"]).withColumn("table", F.lit("nation"))
    made = made.unionByName(I.table_hash(tables["customer"]).select((F.col("rows") + 1).alias("rows"), "content_hash", F.lit("customer").alias("table")))
    made = made.unionByName(I.table_hash(tables["supplier"]).select("rows", F.lit("sha256:0").alias("content_hash"), F.lit("supplier").alias("table")))
    made = made.unionByName(I.table_hash(tables["nation"]).withColumn("table", F.lit("gone")))
    return I.verify_bundle(tables, made)


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'forbidden' WHEN 'view' THEN 'not_found' WHEN 'click' THEN 'unsupported' ELSE 'partially_resolved' END AS status FROM events")
def q12_status_from_http(spark, d):
    code = F.when(F.col("event_type") == "error", 403).when(F.col("event_type") == "view", 404).when(F.col("event_type") != "click", 500)
    return table(spark, d, "events").select("event_id", I.status_from_http(code).alias("status"))


@query("WITH a AS (SELECT l_returnflag AS c, count(*) AS left_n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_returnflag AS c, count(*) AS right_n FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) SELECT c, coalesce(left_n, 0) AS left_n, coalesce(right_n, 0) AS right_n FROM a FULL JOIN b USING (c) WHERE coalesce(left_n, 0) <> coalesce(right_n, 0)")
def q14_fidelity_compare(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("c"), "l_linenumber")
    return I.fidelity_compare(rows.where("l_linenumber <= 3"), rows.where("l_linenumber > 3"), "c")


@query("SELECT DISTINCT user_id AS id, unnest(list_filter([CASE WHEN event_type NOT IN ('view', 'search') THEN 'mutation' END, CASE WHEN user_id % 4 = 0 THEN 'caller-data' END, CASE WHEN event_type = 'error' THEN 'secret' END, CASE WHEN event_type = 'click' THEN 'execution' END], lambda x: x IS NOT NULL)) AS violation FROM events WHERE event_type <> 'click' OR TRUE")
def q10_permission_audit(spark, d):
    action = F.when(F.col("event_type") == "click", "execute").otherwise(F.col("event_type"))
    policy = table(spark, d, "events").select(F.col("user_id").alias("id"), F.when(F.col("user_id") % 4 == 0, "conversation").otherwise("routing").alias("domain"), F.when(F.col("event_type") == "error", "apiToken").otherwise("queue").alias("entity"), action.alias("action"))
    return I.permission_audit(policy)


@query("SELECT DISTINCT 'op' || user_id % 20 AS operation, 'perm' || user_id % 20 AS permission FROM events WHERE event_type = 'error' AND user_id % 20 % 3 <> 0")
def q11_missing_permissions(spark, d):
    op = F.col("user_id") % 20
    rows = table(spark, d, "events").select(F.concat(F.lit("op"), op.cast("string")).alias("operation"), F.when(F.col("event_type") == "error", 403).otherwise(200).alias("status"), F.when(op % 3 == 0, " ").otherwise(F.concat(F.lit("perm"), op.cast("string"))).alias("permission"))
    return I.missing_permissions(rows, rows.select("operation", "permission").distinct())


@query("SELECT count(*) AS assets, count(*) FILTER (doc_id % 50 = 0) AS unstable, 'FAIL' AS verdict FROM documents")
def q18_stability_gate(spark, d):
    docs = table(spark, d, "documents")
    first = docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    second = docs.select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return I.stability_gate(first, second)


@query("SELECT count(*) AS refs, count(l_partkey) AS with_id, count(DISTINCT l_partkey) AS ids FROM lineitem")
def q15_reference_audit(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("refs"), F.count("l_partkey").alias("with_id"), F.countDistinct("l_partkey").alias("ids"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[^ -~\\n]')")
def q19_content_leak_scan(spark, d):
    return table(spark, d, "documents").where(F.rlike("text", F.lit("[^ -~\\n]"))).select("doc_id")


# ---------------------------------------------------------------- aggregations and joins
@query(f"WITH {R_SQL} SELECT split_part(dst, ':', 1) AS type, count(*) AS refs FROM redge GROUP BY ALL")
def a3_dependency_counts(spark, d):
    return resource_graph(spark, d)[1].groupBy(F.element_at(F.split("dst", ":"), 1).alias("type")).agg(F.count("*").alias("refs"))


@query("SELECT o_custkey AS flow_id, count(*) FILTER (o_orderstatus = 'F') AS confidential, count(*) FILTER (o_orderstatus = 'P') AS redacted FROM orders GROUP BY ALL")
def a4_evidence_counts(spark, d):
    on = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("flow_id")).agg(on("F").alias("confidential"), on("P").alias("redacted"))


@query(f"WITH {V_SQL} SELECT variable_id, count(DISTINCT flow_id) AS flows, array_to_string(list_sort(list(DISTINCT mode)), ',') AS modes FROM variable_use GROUP BY ALL")
def a10_distinct_sorted_set(spark, d):
    return variables(spark, d)[1].groupBy("variable_id").agg(F.countDistinct("flow_id").alias("flows"), F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"))


@query(GRAPH + f" SELECT source_type, count(DISTINCT flow_id) AS flows FROM terminal WHERE {KIND} = 'transfer' GROUP BY ALL")
def a11_queue_coverage(spark, d):
    node, edge, _ = control_graph(spark, d)
    ends = G.terminal_nodes(node, edge).where(G.exit_kind() == "transfer")
    return ends.groupBy("source_type").agg(F.countDistinct("flow_id").alias("flows"))


@query(f"WITH {P_SQL} SELECT type, count(*) AS flows, count(published_version) AS published, bool_and(published_version IS NOT NULL) AS all_published, max(name) AS last FROM flow GROUP BY ALL")
def a14_corpus_census(spark, d):
    return catalogue(spark, d).groupBy("type").agg(F.count("*").alias("flows"), F.count("published_version").alias("published"), F.bool_and(F.col("published_version").isNotNull()).alias("all_published"), F.max("name").alias("last"))


@query(f"WITH {M_SQL} SELECT status, count(*) AS flows FROM discovered GROUP BY ALL")
def a16_status_counts(spark, d):
    return manifest_pair(spark, d)[1].groupBy("status").agg(F.count("*").alias("flows"))


@query(f"WITH {O_SQL} SELECT coalesce(b.flow_id, a.flow_id) AS flow_id, coalesce(b.node_id, a.node_id) AS node_id, CASE WHEN b.flow_id IS NULL THEN 'added' WHEN a.flow_id IS NULL THEN 'removed' ELSE 'matched' END AS op FROM before b FULL JOIN later a ON a.flow_id = b.flow_id AND a.node_id = b.node_id")
def j5_full_outer(spark, d):
    return D.match(*snapshot_pair(spark, d), ["flow_id", "node_id"]).select("flow_id", "node_id", "op")


@query(f"WITH {O_SQL} SELECT flow_id, node_id FROM before ANTI JOIN later USING (flow_id, node_id)")
def u3_difference(spark, d):
    before, after = snapshot_pair(spark, d)
    return before.join(after, ["flow_id", "node_id"], "left_anti").select("flow_id", "node_id")


@query(f"WITH {O_SQL} SELECT flow_id, node_id FROM before SEMI JOIN later USING (flow_id, node_id)")
def u4_intersection(spark, d):
    before, after = snapshot_pair(spark, d)
    return before.join(after, ["flow_id", "node_id"], "left_semi").select("flow_id", "node_id")


@query(f"WITH {R_SQL} SELECT key, type FROM rnode UNION SELECT 'nation:' || n_nationkey, 'stale' FROM nation WHERE n_nationkey % 8 = 0")
def g11_merge_graphs(spark, d):
    node, _ = resource_graph(spark, d)
    stale = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("key"), F.lit("stale").alias("type"))
    return R.merge_graphs(stale, node)


@query(f"WITH {R_SQL} SELECT dst AS key, count(DISTINCT src) AS consumers FROM redge WHERE dst LIKE 'nation:%' GROUP BY ALL")
def g13_consuming_flows(spark, d):
    return resource_graph(spark, d)[1].where(F.startswith("dst", F.lit("nation:"))).groupBy(F.col("dst").alias("key")).agg(F.countDistinct("src").alias("consumers"))


@query("SELECT o_custkey AS flow_id, o_orderkey FROM (SELECT *, sum(length(o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS used FROM orders) WHERE used <= 60")
def w4_byte_budget(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "orders").withColumn("used", F.sum(F.length("o_orderpriority")).over(w))
    return rows.where("used <= 60").select(F.col("o_custkey").alias("flow_id"), "o_orderkey")


@query(f"WITH {P_SQL} SELECT type, flow_id FROM flow WHERE published_version IS NOT NULL QUALIFY row_number() OVER (PARTITION BY type ORDER BY flow_id) <= 5")
def w6_first_published(spark, d):
    rows = catalogue(spark, d).where("published_version is not null").withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy("flow_id")))
    return rows.where("r <= 5").select("type", "flow_id")


@query(f"WITH {P_SQL} SELECT division_id, array_to_string(list_sort(list(flow_id))[1:3], ',') || CASE WHEN count(*) > 3 THEN ' (+' || count(*) - 3 || ' more)' ELSE '' END AS sample FROM flow GROUP BY ALL")
def t5_sample_text(spark, d):
    ids = F.array_join(F.slice(F.array_sort(F.collect_list("flow_id")), 1, 3), ",")
    more = F.when(F.count("*") > 3, F.concat(F.lit(" (+"), (F.count("*") - 3).cast("string"), F.lit(" more)"))).otherwise("")
    return catalogue(spark, d).groupBy("division_id").agg(F.concat(ids, more).alias("sample"))


# ---------------------------------------------------------------- reports
@query(GRAPH + " SELECT n.flow_id, n.nodes, coalesce(e.edges, 0) AS edges, coalesce(t.terminals, 0) AS terminals FROM (SELECT flow_id, count(*) AS nodes FROM node GROUP BY 1) n LEFT JOIN (SELECT flow_id, count(*) AS edges FROM edge GROUP BY 1) e USING (flow_id) LEFT JOIN (SELECT flow_id, count(*) AS terminals FROM terminal GROUP BY 1) t USING (flow_id)")
def b2_structure(spark, d):
    node, edge, _ = control_graph(spark, d)
    count = lambda df, c: df.groupBy("flow_id").agg(F.count("*").alias(c))
    out = count(node, "nodes").join(count(edge, "edges"), "flow_id", "left").join(count(G.terminal_nodes(node, edge), "terminals"), "flow_id", "left")
    return out.fillna(0, ["edges", "terminals"])


@query(GRAPH + " SELECT flow_id, node_id, name, source_type, support_level, row_number() OVER (PARTITION BY flow_id ORDER BY ord) AS line FROM node")
def b3_action_inventory(spark, d):
    w = Window.partitionBy("flow_id").orderBy("ord")
    return control_graph(spark, d)[0].select("flow_id", "node_id", "name", "source_type", "support_level", F.row_number().over(w).cast("long").alias("line"))


@query(GRAPH + ", s AS (SELECT flow_id, max(size) AS largest, count(*) AS cycles FROM scc GROUP BY 1) SELECT n.flow_id, coalesce(cycles, 0) AS cycles, coalesce(largest, 0) AS largest FROM (SELECT DISTINCT flow_id FROM node) n LEFT JOIN s USING (flow_id)")
def b9_graph_findings(spark, d):
    node, edge, _ = control_graph(spark, d)
    s = G.strongly_connected_components(node, edge).groupBy("flow_id").agg(F.max("size").alias("largest"), F.count("*").alias("cycles"))
    return node.select("flow_id").distinct().join(s, "flow_id", "left").fillna(0, ["largest", "cycles"]).select("flow_id", "cycles", "largest")


@query(GRAPH + f" SELECT {KIND} AS exit_kind, count(*) AS exits, count(DISTINCT flow_id) AS flows FROM terminal GROUP BY ALL")
def b11_business_exits(spark, d):
    node, edge, _ = control_graph(spark, d)
    return G.terminal_nodes(node, edge).groupBy(G.exit_kind().alias("exit_kind")).agg(F.count("*").alias("exits"), F.countDistinct("flow_id").alias("flows"))


@query(GRAPH + ", gap AS (SELECT flow_id, 'partial' AS gap FROM node WHERE support_level = 'partial' UNION ALL SELECT flow_id, 'failure-path' FROM edge WHERE role = 'failure') SELECT flow_id, gap, count(*) AS n FROM gap GROUP BY ALL")
def b12_operations_gaps(spark, d):
    node, edge, _ = control_graph(spark, d)
    gaps = node.where("support_level = 'partial'").select("flow_id", F.lit("partial").alias("gap")).unionByName(edge.where("role = 'failure'").select("flow_id", F.lit("failure-path").alias("gap")))
    return gaps.groupBy("flow_id", "gap").agg(F.count("*").alias("n"))


@query(GRAPH + ", part AS (SELECT flow_id, node_id, (row_number() OVER (PARTITION BY flow_id ORDER BY node_id) - 1) // 3 AS part FROM node) SELECT e.flow_id, a.part, count(*) AS edges FROM edge e JOIN part a ON a.flow_id = e.flow_id AND a.node_id = e.src JOIN part b ON b.flow_id = e.flow_id AND b.node_id = e.dst AND b.part = a.part GROUP BY ALL")
def b14_diagram_parts(spark, d):
    node, edge, _ = control_graph(spark, d)
    part = node.select("flow_id", "node_id", F.floor((F.row_number().over(Window.partitionBy("flow_id").orderBy("node_id")) - 1) / 3).cast("long").alias("part"))
    a, b = (part.select("flow_id", F.col("node_id").alias(c), F.col("part").alias(p)) for c, p in (("src", "part"), ("dst", "to_part")))
    return edge.join(a, ["flow_id", "src"]).join(b, ["flow_id", "dst"]).where("part = to_part").groupBy("flow_id", "part").agg(F.count("*").alias("edges"))


@query(GRAPH + " SELECT flow_id, role, count(*) AS n FROM edge GROUP BY ALL")
def b7_dependencies(spark, d):
    return control_graph(spark, d)[1].groupBy("flow_id", "role").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'wav' WHEN 'click' THEN 'mp3' ELSE 'bin' END AS extension FROM events")
def f18_asset_extension(spark, d):
    known = F.create_map(*(F.lit(x) for p in (("view", "wav"), ("click", "mp3")) for x in p))
    return table(spark, d, "events").select("event_id", F.coalesce(F.element_at(known, F.col("event_type")), F.lit("bin")).alias("extension"))


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') || 'Z_' || left(sha256(CAST(event_id AS VARCHAR)), 6) AS capture_id, ts + INTERVAL 15 MINUTE AS expires FROM events")
def f19_capture_id(spark, d):
    stamp = F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lit("Z_"), F.left(F.sha2(F.col("event_id").cast("string"), 256), F.lit(6)))
    return table(spark, d, "events").select("event_id", stamp.alias("capture_id"), (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("expires"))


@query()
def c10_retire_stream(spark, d):
    """The batch form of the streaming rule, for comparison; the stream itself runs in the tests."""
    from flowlake.operators.incremental import confirm_retired

    return confirm_retired(table(spark, d, "events").select(F.col("user_id").alias("flow_id"), F.col("ts").alias("run"), (F.col("event_type") == "error").alias("absent")))
