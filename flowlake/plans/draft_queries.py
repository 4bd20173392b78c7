"""Drafts of thirty claims in three sections, one a document, that break each rule in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import grounding as V
from flowlake.plans.registry import query
from flowlake.plans.snapshot_queries import forbid_sql
from flowlake.plans.views import table

SECTION, DRAFT = (4, 110), (7, 230)
NAMES = "[" + ", ".join(f"'{s}'" for s in [*V.SECTIONS, "appendix"]) + "]"
_QUOTES = """list_filter(list_concat(regexp_extract_all(text, '"([^"]*)"', 1), regexp_extract_all(text, '`([^`]*)`', 1), regexp_extract_all(text, '“([^”]*)”', 1)), lambda x: length(x) > 0)"""
_FOLD = lambda name, key, rows, most, chars, full: f"""{name} AS (SELECT {key}, 0::BIGINT AS r, 0::BIGINT AS used, 0::BIGINT AS kept, NULL::BIGINT AS id, NULL::VARCHAR AS code FROM (SELECT DISTINCT {key} FROM {rows})
  UNION ALL SELECT {", ".join("f." + k for k in key.split(", "))}, i.r, CASE WHEN f.kept < {most} AND i.own IS NULL AND f.used + i.n <= {chars} THEN f.used + i.n ELSE f.used END, CASE WHEN f.kept < {most} AND i.own IS NULL AND f.used + i.n <= {chars} THEN f.kept + 1 ELSE f.kept END, i.id,
    CASE WHEN f.kept >= {most} THEN '{full}' WHEN i.own IS NOT NULL THEN i.own WHEN f.used + i.n > {chars} THEN '{full}' END FROM {name} f JOIN {rows} i ON {" AND ".join(f"i.{k} = f.{k}" for k in key.split(", "))} AND i.r = f.r + 1)"""  # noqa: E731

DRAFT_SQL = f"""WITH RECURSIVE doc AS (SELECT doc_id, doc_id // 30 AS flow_id, doc_id % 30 // 10 AS section, doc_id % 10 AS claim_idx, doc_id % 13 AS m, (doc_id // 13 + doc_id % 13) % 4 AS v, coalesce(text, '') AS body FROM documents),
claim AS (SELECT doc_id AS id, flow_id, section, claim_idx, {NAMES}[(flow_id + section * 3) % 8 + 1] AS section_id,
  CASE m WHEN 0 THEN NULL WHEN 1 THEN repeat('x', 501) WHEN 2 THEN 'see https://a.example' WHEN 3 THEN 'says "' || repeat('y ', 61) || '"' WHEN 4 THEN 'says `made up words`' WHEN 10 THEN 'says `made up words` and "' || repeat('y ', 61) || '"' WHEN 11 THEN 'quotes “' || left(body, 12) || '” ""' ELSE left(body, 40) END AS text,
  CASE WHEN m = 7 THEN 'inference' WHEN m = 12 AND v = 0 THEN 'opinion' ELSE ['fact', 'derived', 'fact', 'unknown'][v + 1] END AS kind,
  CASE m WHEN 5 THEN [doc_id, -1] WHEN 6 THEN [] WHEN 9 THEN [doc_id - doc_id % 30] ELSE [doc_id, doc_id] END AS ids,
  CASE WHEN m = 8 THEN 'node' WHEN m = 9 THEN 'general' WHEN v < 2 THEN 'flow' WHEN m = 12 AND v = 1 THEN 'else' END AS subject_kind, CASE WHEN m = 8 THEN doc_id + v ELSE doc_id END AS subject_id FROM doc),
quote AS (SELECT flow_id, id, unnest(q) AS quote, generate_subscripts(q, 1) AS pos FROM (SELECT flow_id, id, {_QUOTES} AS q FROM claim WHERE text IS NOT NULL)),
bad AS (SELECT id, arg_min(bad, pos) AS bad FROM (SELECT *, CASE WHEN length(quote) > 120 THEN 'quotation-too-long' WHEN NOT EXISTS (FROM doc d WHERE d.flow_id = q.flow_id AND contains(d.body, quote)) THEN 'quotation-not-in-corpus' END AS bad FROM quote q) WHERE bad IS NOT NULL GROUP BY id),
judged AS (SELECT c.*, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY flow_id, section ORDER BY claim_idx) AS r, CASE WHEN text IS NULL OR kind = 'opinion' OR subject_kind = 'else' THEN 'malformed' WHEN length(text) > 500 THEN 'too-large' WHEN ({forbid_sql('text')}) IS NOT NULL THEN 'forbidden-pattern'
  WHEN bad.bad IS NOT NULL THEN bad.bad WHEN list_contains(ids, -1) THEN 'unknown-evidence' WHEN len(ids) = 0 AND kind <> 'unknown' THEN 'no-evidence' WHEN kind = 'inference' THEN 'inference-not-allowed'
  WHEN kind IN ('fact', 'derived') AND (subject_kind = 'flow' AND (NOT list_contains(ids, subject_id)) OR subject_kind = 'node' AND subject_id <> c.id) THEN 'unsupported-subject' END AS own FROM claim c LEFT JOIN bad ON bad.id = c.id),
open AS (SELECT * FROM judged WHERE section_id <> 'appendix'),
{_FOLD('by_section', 'flow_id, section', 'open', *SECTION, 'section-too-large')},
passed AS (SELECT o.flow_id, o.section, o.id, o.n, NULL AS own, row_number() OVER (PARTITION BY o.flow_id ORDER BY o.section, o.claim_idx) AS r, row_number() OVER (PARTITION BY o.flow_id, o.section ORDER BY o.claim_idx) - 1 AS place FROM open o JOIN by_section USING (id) WHERE code IS NULL),
{_FOLD('by_draft', 'flow_id', 'passed', *DRAFT, 'draft-too-large')},
outcome AS (SELECT o.flow_id, o.section, o.section_id, o.claim_idx, coalesce(s.code, d.code) AS failure, CASE WHEN d.code IS NULL THEN o.claim_idx ELSE p.place END AS reported_idx FROM open o JOIN by_section s ON s.id = o.id LEFT JOIN by_draft d ON d.id = o.id LEFT JOIN passed p ON p.id = o.id
  UNION ALL SELECT DISTINCT flow_id, section, section_id, NULL, 'section-not-allowed', NULL FROM judged WHERE section_id = 'appendix')"""


def _draft(spark, d):
    """Claims, evidence, corpus and subjects: a document says one claim and is one piece of evidence, about its flow and one node."""
    doc_id = F.col("doc_id")
    doc = table(spark, d, "documents").select("doc_id", F.floor(doc_id / 30).alias("flow_id"), F.floor(doc_id % 30 / 10).alias("section"), (doc_id % 10).alias("claim_idx"), (doc_id % 13).alias("m"), ((F.floor(doc_id / 13) + doc_id % 13) % 4).alias("v"), F.coalesce("text", F.lit("")).alias("body"))
    m, v, long = F.col("m"), F.col("v"), 'says "' + "y " * 61 + '"'
    text = F.when(m == 1, "x" * 501).when(m == 2, "see https://a.example").when(m == 3, long).when(m == 4, "says `made up words`").when(m == 10, "says `made up words` and " + long[5:])
    text = F.when(m != 0, text.when(m == 11, F.concat(F.lit("quotes “"), F.left("body", F.lit(12)), F.lit('” ""'))).otherwise(F.left("body", F.lit(40))))
    of = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    kind = F.when(m == 7, "inference").when((m == 12) & (v == 0), "opinion").otherwise(of(["fact", "derived", "fact", "unknown"], v))
    ids = F.when(m == 5, F.array(doc_id, F.lit(-1).cast("long"))).when(m == 6, F.array().cast("array<bigint>")).when(m == 9, F.array(doc_id - doc_id % 30)).otherwise(F.array(doc_id, doc_id))
    subject = F.when(m == 8, "node").when(m == 9, "general").when(v < 2, "flow").when((m == 12) & (v == 1), "else")
    claim = doc.select("flow_id", "section", "claim_idx", of([*V.SECTIONS, "appendix"], (F.col("flow_id") + F.col("section") * 3) % 8).alias("section_id"), text.alias("text"), kind.alias("kind"), ids.alias("evidence_ids"), subject.alias("subject_kind"), F.when(m == 8, doc_id + v).otherwise(doc_id).alias("subject_id"))
    evidence = doc.select("flow_id", doc_id.alias("evidence_id"))
    index = V.subject_index(evidence.select("*", F.explode(F.array(F.lit("flow"), F.lit("node"))).alias("kind"), F.col("evidence_id").alias("id")))
    return claim, evidence, doc.select("flow_id", F.col("body").alias("text")), index


@query(DRAFT_SQL + " SELECT * FROM outcome")
def v5_validate_draft(spark, d):
    return V.validate_draft(*_draft(spark, d), *SECTION, *DRAFT)


@query(DRAFT_SQL + " SELECT coalesce(failure, 'accepted') AS outcome, count(*) AS claims, count(DISTINCT flow_id) AS flows FROM outcome GROUP BY ALL")
def v10_draft_outcomes(spark, d):
    rows = V.validate_draft(*_draft(spark, d), *SECTION, *DRAFT)
    return rows.groupBy(F.coalesce("failure", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("claims"), F.countDistinct("flow_id").alias("flows"))
