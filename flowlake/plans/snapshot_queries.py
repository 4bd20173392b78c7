"""Diff, incremental, resource-graph and text queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlake.functions import text as X
from flowlake.functions.nfc import nfc
from flowlake.operators import diff as D
from flowlake.operators import incremental as C
from flowlake.operators import normalize as N
from flowlake.operators import quality as I
from flowlake.operators import resources as R
from flowlake.plans.registry import query
from flowlake.plans.views import M_SQL, O_SQL, P_SQL, R_SQL, catalogue, manifest_pair, resource_graph, snapshot_pair, table

# ---------------------------------------------------------------- diff (view O)
OPS = f"""WITH {O_SQL}, d AS (SELECT coalesce(b.flow_id, a.flow_id) AS flow_id, coalesce(b.node_id, a.node_id) AS node_id, b.node_id IS NOT NULL AS in_b, a.node_id IS NOT NULL AS in_a,
  b.n IS DISTINCT FROM a.n AS dn, b.top IS DISTINCT FROM a.top AS dt, b.statuses IS DISTINCT FROM a.statuses AS ds FROM before b FULL JOIN later a ON a.flow_id = b.flow_id AND a.node_id = b.node_id),
ops AS (SELECT flow_id, node_id, CASE WHEN NOT in_b THEN 'added' WHEN NOT in_a THEN 'removed' WHEN dn OR dt OR ds THEN 'changed' ELSE 'same' END AS op,
  CASE WHEN in_a AND in_b THEN concat_ws(',', CASE WHEN dn THEN 'n' END, CASE WHEN dt THEN 'top' END, CASE WHEN ds THEN 'statuses' END) ELSE '' END AS fields FROM d)"""


def _diff(spark, d):
    return D.diff(*snapshot_pair(spark, d), ["flow_id", "node_id"], ["n", "top"], ["statuses"])


@query(OPS + " SELECT * FROM ops")
def d2_diff_nodes(spark, d):
    return _diff(spark, d).withColumn("fields", F.array_join("fields", ","))


@query(f"WITH {O_SQL} SELECT flow_id, count(*) AS matched FROM before SEMI JOIN later USING (flow_id, node_id) GROUP BY ALL")
def d1_match_nodes(spark, d):
    rows = D.match(*snapshot_pair(spark, d), ["flow_id", "node_id"]).where("op = 'matched'")
    return rows.groupBy("flow_id").agg(F.count("*").alias("matched"))


@query(OPS + ", r AS (SELECT flow_id, min(node_id) AS removed FROM ops WHERE op = 'removed' GROUP BY 1 HAVING count(*) = 1), a AS (SELECT flow_id, min(node_id) AS added FROM ops WHERE op = 'added' GROUP BY 1 HAVING count(*) = 1) SELECT * FROM r JOIN a USING (flow_id)")
def d3_slot_pairs(spark, d):
    rows = _diff(spark, d)
    side = lambda op: rows.where(F.col("op") == op).select("flow_id", "node_id")
    return D.pair_slots(side("removed"), side("added"), ["flow_id"]).select("flow_id", F.col("removed.node_id").alias("removed"), F.col("added.node_id").alias("added"))


KINDS = ["flow-metadata-changed", "entry-point-changed", "menu-choice-changed", "action-changed", "condition-expression-changed", "variable-changed", "prompt-reference-changed",
         "dependency-changed", "outcome-path-changed", "published-version-only-changed", "coverage-changed", "unclassified-change"]
CHANGE_SQL = f"""change AS (SELECT l_suppkey AS flow_id, ([{", ".join(repr(k) for k in KINDS)}])[l_orderkey % 12 + 1] AS category, l_linenumber % 2 = 0 AS even, l_returnflag = 'R' AS returned
  FROM lineitem WHERE l_returnflag <> 'N' AND NOT (l_suppkey % 3 = 0 AND l_orderkey % 12 = 10) AND l_suppkey % 17 <> 0)"""


def _reviewable(spark, d):
    """A change a returned or accepted line, of every kind in turn."""
    lines = table(spark, d, "lineitem").where("l_returnflag <> 'N' AND NOT (l_suppkey % 3 = 0 AND l_orderkey % 12 = 10) AND l_suppkey % 17 <> 0")
    even, returned = F.col("l_linenumber") % 2 == 0, F.col("l_returnflag") == "R"
    category = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_orderkey") % 12 + 1).cast("int"))
    aspect = F.when(category == "menu-choice-changed", F.when(even, "label").otherwise("target")).otherwise(F.when(even, "relabeled").otherwise("added"))
    return lines.select(
        F.col("l_suppkey").alias("flow_id"), category.alias("category"), F.when(even, "secure").otherwise("description").alias("field"), aspect.alias("aspect"), returned.alias("secure"),
        F.when(even & returned, "oauthClient").when(even, "queue").alias("dependency_type"), F.when(returned, "regressed").otherwise("improved").alias("direction"),
    )


REVIEWED = """r AS (SELECT flow_id, CASE category WHEN 'flow-metadata-changed' THEN CASE WHEN even THEN 'security-sensitive' ELSE 'cosmetic' END
  WHEN 'menu-choice-changed' THEN CASE WHEN even THEN 'cosmetic' ELSE 'behavioral' END WHEN 'action-changed' THEN CASE WHEN even THEN 'cosmetic' ELSE 'behavioral' END
  WHEN 'variable-changed' THEN CASE WHEN returned THEN 'security-sensitive' ELSE 'behavioral' END WHEN 'prompt-reference-changed' THEN 'documentation-only' WHEN 'published-version-only-changed' THEN 'documentation-only'
  WHEN 'dependency-changed' THEN CASE WHEN even AND returned THEN 'security-sensitive' ELSE 'dependency' END WHEN 'coverage-changed' THEN CASE WHEN returned THEN 'coverage-regression' ELSE 'documentation-only' END ELSE 'behavioral' END AS review FROM change)"""


@query(f"""WITH {CHANGE_SQL}, {REVIEWED}, f AS (SELECT s_suppkey AS flow_id FROM supplier)
SELECT f.flow_id, count(*) FILTER (review = 'cosmetic') AS cosmetic, CASE WHEN count(review) = 0 THEN 1 ELSE count(*) FILTER (review = 'documentation-only') END AS documentation_only, count(*) FILTER (review = 'behavioral') AS behavioral,
  count(*) FILTER (review = 'dependency') AS dependency, count(*) FILTER (review = 'security-sensitive') AS security_sensitive, count(*) FILTER (review = 'coverage-regression') AS coverage_regression,
  CASE WHEN bool_or(review = 'coverage-regression') THEN 'blocked' WHEN bool_or(review = 'security-sensitive') THEN 'security-lead-review' WHEN bool_or(review = 'dependency') THEN 'engineer-review-required'
    WHEN bool_or(review = 'behavioral') THEN 'human-review-required' WHEN count(review) = 0 OR bool_or(review = 'documentation-only') THEN 'automated-plus-spot-check' ELSE 'light-review' END AS highest_review,
  coalesce(bool_or(review = 'coverage-regression'), FALSE) AS blocks_approval FROM f LEFT JOIN r USING (flow_id) GROUP BY f.flow_id""")
def d9_classify_changes(spark, d):
    return D.classify(_reviewable(spark, d), table(spark, d, "supplier").select(F.col("s_suppkey").alias("flow_id")))


@query(f"WITH {CHANGE_SQL}, {REVIEWED} SELECT review, count(*) AS changes FROM r GROUP BY ALL")
def a7_review_counts(spark, d):
    own = D.review_category(*(F.col(c) for c in ("category", "field", "aspect", "secure", "dependency_type", "direction")))
    return _reviewable(spark, d).groupBy(own.alias("review")).agg(F.count("*").alias("changes"))


@query("SELECT event_type, regexp_matches(CASE WHEN event_id % 3 = 0 THEN 'OAuthProvider' ELSE event_type END, '(?i)auth|credential|oauth|secret|token') AS auth, count(*) AS n FROM events GROUP BY ALL")
def p7_auth_related(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, "OAuthProvider").otherwise(F.col("event_type"))
    return table(spark, d, "events").groupBy("event_type", D.auth_related(kind).alias("auth")).agg(F.count("*").alias("n"))


@query(OPS + """, h AS (SELECT o_custkey AS flow_id, max(o_orderkey) FILTER (o_orderdate < TIMESTAMP '1998-06-01') AS hb, max(o_orderkey) FILTER (o_orderdate >= TIMESTAMP '1998-06-01') AS ha FROM orders GROUP BY 1)
SELECT flow_id, hb IS DISTINCT FROM ha AS hash_changed, hb IS DISTINCT FROM ha AND NOT EXISTS (FROM ops o WHERE o.flow_id = h.flow_id AND op <> 'same') AS positional_only FROM h""")
def d8_positional_only(spark, d):
    orders, cut = table(spark, d, "orders"), F.lit("1998-06-01").cast("timestamp")
    old = F.col("o_orderdate") < cut
    hashes = orders.groupBy(F.col("o_custkey").alias("flow_id")).agg(F.max(F.when(old, F.col("o_orderkey"))).alias("hash_before"), F.max(F.when(~old, F.col("o_orderkey"))).alias("hash_after"))
    return D.positional_only(_diff(spark, d), hashes)


@query(OPS + " SELECT flow_id, count(*) FILTER (op = 'added') AS added, count(*) FILTER (op = 'removed') AS removed, count(*) FILTER (op = 'changed') AS changed, array_to_string(list_sort(list(node_id) FILTER (op = 'added'))[1:2], ',') AS first_added FROM ops GROUP BY ALL")
def d12_diff_summary(spark, d):
    n = lambda op: F.count_if(F.col("op") == op).alias(op)
    some = F.slice(F.array_sort(F.collect_list(F.when(F.col("op") == "added", F.col("node_id")))), 1, 2)
    return _diff(spark, d).groupBy("flow_id").agg(n("added"), n("removed"), n("changed"), F.when(n("added") > 0, F.array_join(some, ",")).alias("first_added"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN NULL WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS text FROM documents")
def d13_untrusted_text(spark, d):
    return table(spark, d, "documents").select("doc_id", D.untrusted_text(F.col("text")).alias("text"))


# ---------------------------------------------------------------- incremental (view M)
DECIDED = f"""WITH {M_SQL}, decided AS (SELECT coalesce(p.flow_id, n.flow_id) AS flow_id, CASE WHEN n.status IS NULL THEN 'not-in-scope' WHEN n.status = 'forbidden' THEN 'inaccessible' WHEN n.status = 'not-found' THEN 'retire-candidate'
  WHEN p.flow_id IS NULL THEN 'new-flow' WHEN n.version IS NOT DISTINCT FROM p.version AND n.division IS NOT DISTINCT FROM p.division THEN 'skip-unchanged' WHEN n.hash IS NULL THEN 'regenerate-pending'
  WHEN n.hash IS NOT DISTINCT FROM p.hash THEN 'metadata-only' ELSE 'regenerate' END AS action, n.status, p.flow_id IS NOT NULL AS known, n.version AS nv, p.version AS pv, n.division AS nd, p.division AS pd
  FROM previous p FULL JOIN discovered n ON n.flow_id = p.flow_id),
plan AS (SELECT *, CASE WHEN action = 'skip-unchanged' THEN 'skip' WHEN action = 'retire-candidate' THEN 'retire' WHEN action IN ('inaccessible', 'not-in-scope') THEN action ELSE 'capture' END AS bucket FROM decided)"""


@query(DECIDED + " SELECT flow_id, action, bucket FROM plan")
def c1_decide_flow_action(spark, d):
    return C.decide(*manifest_pair(spark, d)).select("flow_id", "action", "bucket")


@query(f"""WITH {M_SQL} SELECT n.flow_id, concat_ws(',', CASE WHEN n.division IS DISTINCT FROM p.division THEN 'DIVISION_CHANGED' END, CASE WHEN coalesce(n.hash, 'none') <> p.hash THEN 'TYPE_CHANGED' END,
  CASE WHEN p.version % 5 <> 0 AND p.version <> n.version THEN 'DISPLAY_NAME_CHANGED' END) AS notes FROM discovered n JOIN previous p ON p.flow_id = n.flow_id WHERE n.status = 'found'""")
def c2_metadata_notes(spark, d):
    previous, found = manifest_pair(spark, d)
    old = previous.select("flow_id", "division", F.col("hash").alias("type"), F.when(F.col("version") % 5 != 0, F.col("version")).alias("name"))
    new = found.where("status = 'found'").select("flow_id", "division", F.coalesce("hash", F.lit("none")).alias("type"), F.col("version").alias("name"))
    return C.metadata_notes(old, new).withColumn("notes", F.array_join("notes", ","))


@query(DECIDED + " SELECT flow_id, n.version, n.division, n.hash, FALSE AS carried FROM plan JOIN discovered n USING (flow_id) WHERE bucket = 'capture' UNION ALL SELECT p.flow_id, p.version, p.division, p.hash, TRUE FROM previous p JOIN plan q ON q.flow_id = p.flow_id AND q.bucket NOT IN ('capture', 'retire')")
def c4_carry_forward(spark, d):
    previous, found = manifest_pair(spark, d)
    plan = C.decide(previous, found)
    captured = found.join(plan.where("bucket = 'capture'").select("flow_id"), "flow_id", "left_semi").select("flow_id", "version", "division", "hash")
    return C.carry_forward(previous, plan, captured)


@query(DECIDED + " SELECT bucket, count(*) AS flows FROM plan GROUP BY ALL")
def c5_incremental_summary(spark, d):
    return C.decide(*manifest_pair(spark, d)).groupBy("bucket").agg(F.count("*").alias("flows"))


@query("WITH j AS (SELECT o_custkey || ':' || o_orderpriority AS job, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) SELECT job FROM j WHERE s <> 'F'")
def c7_resume_skip(spark, d):
    job = F.concat_ws(":", F.col("o_custkey").cast("string"), "o_orderpriority")
    journal = table(spark, d, "orders").select(job.alias("job"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"), F.col("o_orderkey").alias("ord"))
    return C.resume_skip(journal.select("job").distinct(), journal)


@query("SELECT o_custkey AS flow_id, o_orderkey AS version FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def w2_latest_version(spark, d):
    return C.latest_version(table(spark, d, "orders").select(F.col("o_custkey").alias("flow_id"), F.col("o_orderkey").alias("version")), "version")


@query("SELECT flow_id, run FROM (SELECT user_id AS flow_id, event_id AS run, event_type = 'error' AS absent, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE absent AND b")
def w7_retire_confirmation(spark, d):
    return C.confirm_retired(table(spark, d, "events").select(F.col("user_id").alias("flow_id"), F.col("event_id").alias("run"), (F.col("event_type") == "error").alias("absent")))


# ---------------------------------------------------------------- resources (view R)
@query(f"WITH RECURSIVE {R_SQL}, ref AS (SELECT key FROM rnode WHERE type = 'supplier' UNION SELECT e.dst FROM ref r JOIN rnode n USING (key) JOIN redge e ON e.src = r.key) SELECT key, CASE WHEN EXISTS (FROM rnode n WHERE n.key = ref.key) THEN 'resolved' ELSE 'not_found' END AS status FROM ref")
def g8_reference_closure(spark, d):
    node, edge = resource_graph(spark, d)
    return R.reference_closure(node.where("type = 'supplier'"), node, edge).select("key", "status")


@query(f"WITH {R_SQL} SELECT key, type FROM rnode WHERE key NOT IN (SELECT dst FROM redge)")
def g10_orphans(spark, d):
    return R.orphans(*resource_graph(spark, d))


@query(f"WITH {R_SQL} SELECT dst, count(*) AS refs, count(DISTINCT src) AS sources FROM redge GROUP BY ALL")
def g12_blast_radius(spark, d):
    return R.blast_radius(resource_graph(spark, d)[1])


@query(f"WITH {R_SQL} SELECT (SELECT count(*) FROM rnode) AS resources, u AS unresolved, u = 0 AS importable, CASE WHEN u > 0 THEN 'unresolved references: ' || u END AS caveat FROM (SELECT count(*) AS u FROM redge WHERE dst NOT IN (SELECT key FROM rnode))")
def q6_migration_readiness(spark, d):
    return R.migration_readiness(R.bundle_counts(*resource_graph(spark, d)))


@query(f"WITH {R_SQL}, g AS (SELECT dst FROM redge WHERE dst NOT IN (SELECT key FROM rnode)) SELECT (SELECT count(*) FROM rnode) AS resources, (SELECT count(DISTINCT type) FROM rnode) AS types, (SELECT count(*) FROM redge) AS refs, (SELECT count(*) FROM g) AS unresolved, (SELECT count(DISTINCT split_part(dst, ':', 1)) FROM g) AS unresolved_types")
def a12_bundle_counts(spark, d):
    return R.bundle_counts(*resource_graph(spark, d))


@query(f"WITH {R_SQL} SELECT src, dst, via FROM redge WHERE dst NOT IN (SELECT key FROM rnode)")
def q5c_dependency_unresolved(spark, d):
    node, edge = resource_graph(spark, d)
    return R.unresolved(edge, node).select("src", "dst", "via")


@query("SELECT 'sha256:' || sha256(text) AS digest, 'doc' || min(doc_id) AS name, min(strlen(text)) AS bytes, array_to_string(list_sort(list(DISTINCT source)), ',') AS used_by FROM documents GROUP BY ALL HAVING true")
def q13_asset_dedupe(spark, d):
    docs = table(spark, d, "documents")
    asset = docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("text").cast("binary").alias("content"), F.col("source").alias("used_by"))
    return R.asset_dedupe(asset).withColumn("used_by", F.array_join("used_by", ","))


# ---------------------------------------------------------------- text (view T)
PROBES = ["", " see https://example.com/x", " mail bob@example.com", " [a](b)", " ```code", " <b>x</b>", " " + "A" * 90, " api_key: x", " call +1 202 555 0101 22", " id 0b7a1c22-aaaa-4bbb-8ccc-0123456789ab is the token", " node 0b7a1c22-aaaa-4bbb-8ccc-0123456789ab"]


def _texts(spark, d):
    probe = F.element_at(F.array(*map(F.lit, PROBES)), (F.col("doc_id") % len(PROBES) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.col("text"), probe).alias("text"))


T_SQL = "t AS (SELECT doc_id, text || ([" + ", ".join(f"'{p}'" for p in PROBES) + f"])[doc_id % {len(PROBES)} + 1] AS text FROM documents)"
CONTROL_RE = X.CONTROL
GUID_SQL = "\\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\b"


def forbid_sql(c: str) -> str:
    first = f"regexp_extract({c}, '(?s)^(.*?){GUID_SQL}')"
    near = f"(length({first}) > 0 AND regexp_matches(right(left({first}, length({first}) - 36), 60) || ' ' || substr({c}, length({first}) + 1, 60), '{X.SECRET_WORD}'))"
    hit = lambda n, p: f"regexp_matches(regexp_replace({c}, '{GUID_SQL}', '', 'g'), '{p}')" if n == "PHONE" else f"regexp_matches({c}, '{p}')"
    return "CASE " + " ".join(f"WHEN {hit(n, p)}{' OR ' + near if n == 'CREDENTIAL_SHAPED' else ''} THEN '{n}'" for n, p in X.FORBIDDEN.items()) + " END"


FORBID = forbid_sql("text")


@query(f"WITH {T_SQL} SELECT doc_id, {FORBID} AS found FROM t")
def f9_forbidden_pattern(spark, d):
    return _texts(spark, d).select("doc_id", X.forbidden_pattern(F.col("text")).alias("found"))


@query("SELECT doc_id, 'sha256:' || sha256(nfc_normalize(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'))) AS digest FROM documents")
def f6_sanitize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash(nfc(X.strip_invisible(X.strip_control(F.col("text"))))).alias("digest"))


@query("""WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS flow_id FROM customer) SELECT flow_id, unnest(['/name', '/Authorization', '/client-Secret', '/list/0/url', '/list/0/PASSWORD', '/list/0/note', '/list/0/n']) AS pointer,
  unnest(['customer ' || flow_id, '[REDACTED:authorization]', '[REDACTED:client-secret]', 'https://host/' || flow_id, '[REDACTED:password]', 'ab', CAST(flow_id AS VARCHAR)]) AS value,
  unnest([NULL, CASE WHEN flow_id % 2 = 1 THEN 'authorization' END, 'client-secret', 'url-credential', 'password', 'control-characters', NULL]) AS category FROM c""")
def f8_redact(spark, d):
    k, s = F.col("c_custkey").cast("long"), F.col("c_custkey").cast("string")
    item = F.struct(F.concat(F.lit("https://u:p@host/"), s).alias("url"), F.lit("x").alias("PASSWORD"), F.lit("a\x07b").alias("note"), k.alias("n"))
    held = F.when(k % 2 == 0, "[REDACTED:authorization]").otherwise(F.concat(F.lit("Bearer "), s))
    doc = F.struct(F.concat(F.lit("customer "), s).alias("name"), held.alias("Authorization"), F.struct(F.struct(F.lit("deep").alias("a")).alias("b")).alias("client-Secret"), F.array(item).alias("list"))
    paths = N.flatten_json(table(spark, d, "customer").select(k.alias("flow_id"), F.to_json(doc).alias("definition")))
    return X.redact(paths).where("value is not null")


@query("""SELECT doc_id, sha256(array_to_string(list_filter(list_concat(regexp_extract_all(q, '"([^"]*)"', 1), regexp_extract_all(q, '`([^`]*)`', 1), regexp_extract_all(q, '“([^”]*)”', 1)), lambda x: length(x) > 0), '|')) AS quotes
FROM (SELECT doc_id, text || ' "' || source || '" and `' || lang || '` “' || doc_id || '” ""a`' AS q FROM documents)""")
def f10_quotations(spark, d):
    q = F.concat("text", F.lit(' "'), "source", F.lit('" and `'), "lang", F.lit("` “"), F.col("doc_id").cast("string"), F.lit('” ""a`'))
    return table(spark, d, "documents").select("doc_id", F.sha2(F.array_join(X.quotations(q), "|"), 256).alias("quotes"))


SLUG = "left(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({0}), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 120)"
NAME_SQL = "CASE page_id % 5 WHEN 0 THEN 'LPT' || (page_id % 9 + 1) WHEN 1 THEN '..' || 'cafe' || chr(769) || ' ' || url ELSE url END"


@query(f"""WITH s AS (SELECT page_id, url, {SLUG.format(NAME_SQL)} AS s FROM pages)
SELECT page_id, CASE WHEN s = '' THEN 'unnamed' WHEN regexp_matches(s, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') THEN s || '-' ELSE s END || '-' || left(sha256(url), 8) AS directory FROM s""")
def f12_flow_directory(spark, d):
    turn = F.col("page_id") % 5
    name = F.when(turn == 0, F.concat(F.lit("LPT"), (F.col("page_id") % 9 + 1).cast("string"))).when(turn == 1, F.concat(F.lit("..cafe\u0301 "), "url")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", X.flow_directory(name, F.sha2("url", 256)).alias("directory"))


@query("SELECT page_id, regexp_replace('https://user:pw@' || substr(url, strpos(url, '://') + 3), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@\\s]+@', '\\1') AS url FROM pages")
def f7_strip_url_credentials(spark, d):
    url = F.concat(F.lit("https://user:pw@"), F.regexp_replace("url", "^[a-z]+://", ""))
    return table(spark, d, "pages").select("page_id", X.strip_url_credentials(url).alias("url"))


@query("SELECT page_id, sha256(replace(replace(replace(left(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g'), 2000), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM pages")
def f13_delimit_untrusted(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(X.delimit_untrusted(F.col("html")), 256).alias("digest"))


@query("SELECT event_id, lower(regexp_replace(regexp_replace(event_type || 'NextStep_' || user_id, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[_ ]+', '-', 'g')) AS kebab FROM events")
def f15_kebab_case(spark, d):
    name = F.concat("event_type", F.lit("NextStep_"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", X.kebab_case(name).alias("kebab"))


CANARY_SQL = """canary AS (SELECT 'b' || item_id AS id, left(text, 40) AS text FROM benchmark WHERE length(text) >= 40 UNION ALL SELECT 'c', 'Customer#000000001' UNION ALL SELECT 'none', 'this is planted nowhere'),
cell AS (SELECT 'documents' AS tbl, 'text' AS col, CAST(doc_id AS VARCHAR) AS key, text AS cell FROM documents UNION ALL SELECT 'documents', 'source', CAST(doc_id AS VARCHAR), source FROM documents
  UNION ALL SELECT 'documents', 'lang', CAST(doc_id AS VARCHAR), lang FROM documents UNION ALL SELECT 'customer', 'c_name', CAST(c_custkey AS VARCHAR), c_name FROM customer
  UNION ALL SELECT 'customer', 'c_mktsegment', CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer UNION ALL SELECT 'pages', 'url', CAST(page_id AS VARCHAR), url FROM pages UNION ALL SELECT 'pages', 'html', CAST(page_id AS VARCHAR), html FROM pages)"""


@query(f"WITH {CANARY_SQL} SELECT DISTINCT tbl AS \"table\", col AS \"column\", key, id AS canary FROM cell JOIN canary ON contains(cell.cell, canary.text)")
def q9_canary_scan(spark, d):
    """Starts of benchmark items and a customer's name, looked for in all texts of three tables."""
    planted = table(spark, d, "benchmark").where(F.length("text") >= 40).select(F.concat(F.lit("b"), F.col("item_id").cast("string")), F.left("text", F.lit(40)))
    canaries = [tuple(r) for r in planted.limit(I.MAX_CANARIES + 1).collect()] + [("c", "Customer#000000001"), ("none", "this is planted nowhere")]
    return I.canary_scan({"documents": (table(spark, d, "documents"), "doc_id"), "customer": (table(spark, d, "customer"), "c_custkey"), "pages": (table(spark, d, "pages"), "page_id")}, canaries)


# ---------------------------------------------------------------- catalogue (view P)
@query(f"WITH {P_SQL} SELECT flow_id, CASE WHEN published_version IS NULL THEN 'unknown' ELSE 'published' END AS state FROM flow WHERE type IN ('BUILDING', 'MACHINERY') AND division_id < 10 AND contains(lower(name), '1')")
def p1_filter_flows(spark, d):
    rows = catalogue(spark, d).where(F.col("type").isin("BUILDING", "MACHINERY") & (F.col("division_id") < 10) & F.contains(F.lower("name"), F.lit("1")))
    return rows.select("flow_id", F.when(F.col("published_version").isNull(), "unknown").otherwise("published").alias("state"))


@query(f"WITH {P_SQL} SELECT type, name, count(DISTINCT coalesce(division_id, -1)) AS divisions FROM flow GROUP BY ALL HAVING count(DISTINCT coalesce(division_id, -1)) > 1")
def q17_name_collisions(spark, d):
    return catalogue(spark, d).groupBy("type", "name").agg(F.countDistinct(F.coalesce("division_id", F.lit(-1))).alias("divisions")).where("divisions > 1")


@query(f"WITH {P_SQL} SELECT lower(type) AS type, count(*) AS flows FROM flow WHERE lower(type) NOT IN ('building', 'machinery') GROUP BY ALL")
def q16_type_coverage(spark, d):
    known = spark.createDataFrame([("building",), ("machinery",)], "type string")
    return catalogue(spark, d).groupBy(F.lower("type").alias("type")).agg(F.count("*").alias("flows")).join(F.broadcast(known), "type", "left_anti")


@query(f"WITH {P_SQL} SELECT type, division_id, count(*) AS flows, count(published_version) AS published FROM flow GROUP BY ROLLUP (type, division_id)")
def b13_inventory(spark, d):
    return catalogue(spark, d).rollup("type", "division_id").agg(F.count("*").alias("flows"), F.count("published_version").alias("published"))


@query(f"WITH {P_SQL}, r AS (SELECT flow_id, type, row_number() OVER (PARTITION BY type ORDER BY flow_id) AS r, count(*) OVER (PARTITION BY type) AS n FROM flow) SELECT type, flow_id, n - 10 AS omitted FROM r WHERE r <= 10")
def t2_cap_list(spark, d):
    w = Window.partitionBy("type")
    rows = catalogue(spark, d).withColumn("r", F.row_number().over(w.orderBy("flow_id"))).withColumn("n", F.count("*").over(w))
    return rows.where("r <= 10").select("type", "flow_id", (F.col("n") - 10).alias("omitted"))


@query(f"WITH {P_SQL} SELECT flow_id, name FROM flow ORDER BY flow_id LIMIT 50 OFFSET 100")
def t3_offset_page(spark, d):
    return catalogue(spark, d).select("flow_id", "name").orderBy("flow_id").offset(100).limit(50)


@query("SELECT o_orderpriority AS type, list_sort(list(o_totalprice))[least(count(*), floor(0.95 * count(*)) + 1)::BIGINT] AS p95, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS most FROM orders GROUP BY 1")
def a13_percentiles(spark, d):
    """Nearest-rank percentiles by rank over the sorted rows of each group, without gathering a group."""
    w = Window.partitionBy("type")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_totalprice").alias("x"))
    hist = rows.groupBy("type", "x").agg(F.count("*").alias("c"))
    hist = hist.withColumn("upto", F.sum("c").over(w.orderBy("x"))).withColumn("n", F.sum("c").over(w))
    p95 = hist.where(F.col("upto") >= F.least("n", F.floor(F.lit(0.95) * F.col("n")) + 1)).groupBy("type").agg(F.min("x").alias("p95"))
    return rows.groupBy("type").agg(F.round(F.avg("x"), 4).alias("mean"), F.max("x").alias("most")).join(p95, "type").select("type", "p95", "mean", "most")
