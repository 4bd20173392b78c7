"""Canonical texts, spoken fragments, pseudonyms, subjects of evidence, unknowns, discovery and sealing."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.functions import predicates as P
from flowlake.functions import text as X
from flowlake.operators import canonical as J
from flowlake.operators import grounding as V
from flowlake.operators import normalize as N
from flowlake.plans.registry import query
from flowlake.plans.report_queries import forbid_sql
from flowlake.plans.views import P_SQL, R_SQL, catalogue, resource_graph, spread, table
from flowlake.sources.bundles import seal_bundle

RECORD = r'{"selfUri":"u%1$d","name":"x\r\n%1$d","list":["b%1$d","a%1$d",{"id":%1$d,"dateModified":"z"}],"edges":["b%1$d","a"],"empty":{},"none":null,"deep":{"downloadUrl":[1],"z":[3,1,2],"a":true}}'
CANONICAL = r"""'{"v":"1","d":{"deep":{"a":true,"z":[1,2,3]},"edges":["b' || k || '","a"],"empty":{},"list":["a' || k || '","b' || k || '",{"id":' || k || '}],"name":"x\n' || k || '","none":null}}'"""


@query(f"SELECT *, 'sha256:' || sha256(canonical) AS content_hash FROM (SELECT k AS flow_id, {CANONICAL} AS canonical FROM (SELECT o_orderkey AS k FROM orders))")
def f1_canonicalize(spark, d):
    docs = spread(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").alias("flow_id"), F.format_string(RECORD, "o_orderkey").alias("definition"))
    return J.canonicalize(N.flatten_json(docs), ordered=["/edges"])


@query("SELECT k, n FROM (SELECT unnest(['dateModified', 'downloadUrl', 'selfUri']) AS k), (SELECT count(*) AS n FROM orders)")
def f3_volatile_keys(spark, d):
    """How often each volatile key stands in the documents, at any depth."""
    docs = spread(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").alias("flow_id"), F.format_string(RECORD, "o_orderkey").alias("definition"))
    return N.flatten_json(docs).where(F.col("key").isin(J.VOLATILE)).groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n"))


SETTINGS = [
    '{"prompts":{"defaultAudio":{"kind":"expression","operands":[{"kind":"literal","dataType":"str","text":"hello %1$d"},{"kind":"expression","operands":[{"kind":"literal","dataType":"str","text":"inner"}]},{"kind":"variableRef"}]}},"question":{"kind":"literal","dataType":"str","text":"last"}}',
    '{"communication":{"kind":"literal","dataType":"str","text":"say %1$d"},"question":{"kind":"literal","dataType":"int","text":"7","operands":[{"kind":"variableRef"}]}}',
    '{"question":{"kind":"opaque","order":%1$d}}', '{"other":{"kind":"literal","dataType":"str","text":"no %1$d"}}', '{"question":"flat %1$d"}',
]


@query("""SELECT o_orderkey AS flow_id, CASE o_orderkey % 5 WHEN 0 THEN 'hello ' || o_orderkey || '|inner|last' WHEN 1 THEN 'say ' || o_orderkey ELSE '' END AS fragments, o_orderkey % 5 IN (0, 2) AS partial FROM orders WHERE o_orderkey % 5 <> 3""")
def f16_inline_text_fragments(spark, d):
    k = F.col("o_orderkey")
    text = F.element_at(F.array(*(F.format_string(s, k) for s in SETTINGS)), (k % 5 + 1).cast("int"))
    rows = J.inline_text_fragments(N.flatten_json(spread(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(k.alias("flow_id"), text.alias("definition"))))
    return rows.withColumn("fragments", F.array_join("fragments", "|"))


WORD = "[" + ", ".join(f"'{w}'" for w in J.WORDS) + "]"
PICK = lambda i: f"{WORD}[('0x' || substr(h, {2 * i}, 1))::INT + 1]"


@query(f"""WITH e AS (SELECT event_id, event_type, user_id, 'name|/name|' || event_type || ' ' || user_id AS seed, sha256(user_id::VARCHAR) AS u FROM events), w AS (SELECT *, sha256(seed) AS h, sha256(substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-' || substr(u, 13, 4) || '-' || substr(u, 17, 4) || '-' || substr(u, 21, 12)) AS g FROM e)
SELECT event_id, upper(left({PICK(1)}, 1)) || substr({PICK(1)}, 2) || ' ' || {PICK(2)} AS name, substr(g, 1, 8) || '-' || substr(g, 9, 4) || '-4' || substr(g, 14, 3) || '-a' || substr(g, 18, 3) || '-' || substr(g, 21, 12) AS id,
  'GetAt(Task.v_' || left(sha256(event_type), 4) || ',0) == "' || {WORD}[ascii(event_type) % 16 + 1] || '" or ""' AS condition, event_type AS kind, 0 AS survivors FROM w""")
def f14_pseudonymize(spark, d):
    u = F.sha2(F.col("user_id").cast("string"), 256)
    cut = lambda at, n: F.substr(u, F.lit(at), F.lit(n))
    e = spread(table(spark, d, "events").select("event_id", "event_type", "user_id"), "event_id").select(F.col("event_id").alias("flow_id"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("name"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)).alias("id"),
                                         F.concat(F.lit("GetAt(Task."), "event_type", F.lit(',0) == "'), "event_type", F.lit('" or ""')).alias("condition"), F.col("event_type").alias("kind"))
    paths = N.flatten_json(e.select("flow_id", F.to_json(F.struct("name", "id", "condition", "kind")).alias("definition")))
    out = J.pseudonymize(paths, structural=["kind"])
    left = J.surviving_guids(paths, out).agg(F.count("*").cast("int").alias("survivors"))
    rows = N.fields_of(out, out.where("depth = 0"), ["name", "id", "condition", "kind"])
    return rows.select(F.col("flow_id").alias("event_id"), "name", "id", "condition", "kind").crossJoin(F.broadcast(left))  # a single row


@query("SELECT DISTINCT conv_id AS flow_id, turn % 5 AS evidence_id, role AS kind, turn % 3 AS id FROM conversations")
def v3_subject_index(spark, d):
    c = table(spark, d, "conversations")
    return V.subject_index(c.select(F.col("conv_id").alias("flow_id"), (F.col("turn") % 5).alias("evidence_id"), F.col("role").alias("kind"), (F.col("turn") % 3).alias("id")))


@query("""SELECT conv_id AS flow_id, turn AS claim_idx, EXISTS (FROM conversations i WHERE i.conv_id = c.conv_id AND i.turn IN (c.turn - 1, c.turn - 2) AND i.role = 'user' AND i.turn % 3 = c.turn % 2) AS supported FROM conversations c WHERE role = 'assistant'""")
def j11_subject_supported(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "flow_id")
    index = V.subject_index(c.select("flow_id", F.col("turn").alias("evidence_id"), F.col("role").alias("kind"), (F.col("turn") % 3).alias("id")))
    claim = c.where("role = 'assistant'").select("flow_id", F.col("turn").alias("claim_idx"), F.array(F.col("turn") - 1, F.col("turn") - 2).alias("evidence_ids"), F.lit("user").alias("subject_kind"), (F.col("turn") % 2).alias("subject_id"))
    return V.subject_supported(claim, index).select("flow_id", "claim_idx", "supported")


@query(f"""WITH u AS (SELECT conv_id AS flow_id, turn AS idx, CASE WHEN turn % 6 <> 5 THEN text END AS text FROM conversations),
o AS (SELECT *, CASE WHEN text IS NULL THEN 'malformed' WHEN length(text) > 200 THEN 'too-large' WHEN ({forbid_sql('text')}) IS NOT NULL THEN 'forbidden-pattern' END AS own FROM u),
r AS (SELECT *, count(*) FILTER (own IS NULL) OVER (PARTITION BY flow_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM o)
SELECT flow_id, idx, CASE WHEN n >= 3 THEN 'draft-too-large' ELSE own END AS failure FROM r""")
def v9_validate_unknowns(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("flow_id"), F.col("turn").alias("idx"), F.when(F.col("turn") % 6 != 5, F.col("text")).alias("text"))
    return V.validate_unknowns(rows, most=3, chars=200).select("flow_id", "idx", "failure")


@query("SELECT doc_id, CASE WHEN strlen(t) <= 64 THEN t ELSE left(t, list_max(list_filter(range(65), lambda i: strlen(left(t, i)) <= 64))) END AS text, strlen(t) > 64 AS truncated FROM (SELECT doc_id, coalesce(text, '') AS x, left('aé€😀', (doc_id % 4 + 1)::INT) || replace(coalesce(text, ''), 'e', 'é€') AS t FROM documents)")
def t6_bounded_bytes(spark, d):
    t = F.concat(F.left(F.lit("aé€😀"), (F.col("doc_id") % 4 + 1).cast("int")), F.replace(F.coalesce("text", F.lit("")), F.lit("e"), F.lit("é€")))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", X.bounded_bytes(F.col("t"), 64).alias("text"), (F.octet_length("t") > 64).alias("truncated"))


@query(f"WITH {P_SQL} SELECT flow_id, name, lower(type) AS type, division_id FROM flow WHERE type IN ('BUILDING', 'MACHINERY') AND division_id IN (1, 2, 3, 7)")
def r3_list_flows(spark, d):
    flows = catalogue(spark, d)
    return P.list_flows(flows.unionByName(flows), ["building", "Machinery"], [1, 2, 3, 7]).select("flow_id", "name", "type", "division_id")


@query(f"""WITH {R_SQL}, n AS (SELECT key, type, TRUE AS ok FROM rnode UNION ALL SELECT DISTINCT dst, split_part(dst, ':', 1), FALSE FROM redge WHERE dst NOT IN (SELECT key FROM rnode)), a AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)
SELECT (SELECT count(*) FROM customer) AS flows, (SELECT count(*) FROM rnode) AS resources, (SELECT count(*) FROM a) AS assets, count(*) FILTER (NOT ok) AS unresolved, coalesce(array_to_string(list_sort(list(DISTINCT type) FILTER (NOT ok)), ','), '') AS unresolved_types,
  (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM a) AS asset_bytes, CASE WHEN count(*) FILTER (NOT ok) > 0 THEN 'GRAPH_TRUNCATED,REFERENCES_UNREAD' ELSE 'GRAPH_TRUNCATED' END AS caveats, count(*) FILTER (NOT ok) = 0 AS importable FROM n""")
def r8_seal_bundle(spark, d):
    node, edge = resource_graph(spark, d)
    lost = edge.select(F.col("dst").alias("key")).distinct().join(node, "key", "left_anti").select("key", F.split_part("key", F.lit(":"), F.lit(1)).alias("type"), F.lit("not_found").alias("status"))
    every = node.select("key", "type", F.lit("resolved").alias("status")).unionByName(lost)
    assets = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("byte_length")).dropDuplicates(["digest"])
    out = seal_bundle(catalogue(spark, d), node, every, assets, truncated=True)
    return out.withColumn("caveats", F.array_join("caveats", ",")).withColumn("unresolved_types", F.array_join("unresolved_types", ",")).drop("content_hash")
