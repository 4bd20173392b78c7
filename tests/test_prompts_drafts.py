"""What callers hear, and drafts, on small made-up tables: each rule, nulls, repeated rows and empty tables."""

import hashlib
import json

from flowlake.operators import grounding as V
from flowlake.operators import prompts as P
from flowlake.operators import reports as R


def rows(df, *order):
    return sorted((tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in order) for r in df.collect()), key=str)


def test_recordings_by_language(spark):
    use = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "none"), (2, "a"), (3, "a"), (1, None), (None, "a"), (4, "c")], "flow_id int, prompt_id string")
    rec = spark.createDataFrame([("a", "EN-us", True), ("a", "en-US", None), ("a", "ar", False), ("b", None, True), ("b", "es", None), (None, "en-us", True), ("c", None, False)], "prompt_id string, language string, has_media boolean")
    languages = spark.createDataFrame([(1, ["en-us"]), (2, ["fr"]), (4, [])], "flow_id int, languages array<string>")
    have = rows(P.select_recordings(use, rec, languages).where("flow_id is not null and prompt_id is not null"), "flow_id", "prompt_id", "match", "available", "chosen", "silent")
    assert have == sorted([
        (1, "a", "exact", ("ar", "en-us"), ("en-us",), ()), (1, "b", "fall-back", ("", "es"), ("", "es"), ("es",)), (1, "none", "missing", (), (), ()),
        (2, "a", "fall-back", ("ar", "en-us"), ("ar", "en-us"), ("ar",)), (3, "a", "all", ("ar", "en-us"), ("ar", "en-us"), ("ar",)), (4, "c", "all", ("",), ("",), ("",)),
    ], key=str)
    assert P.select_recordings(use, rec.limit(0), languages.limit(0)).where("match <> 'missing'").count() == 0
    assert P.select_recordings(use.limit(0), rec, languages).count() == 0


def test_declared_languages(spark):
    texts = ['{"supportedLanguages":["EN-us","en-US",3,"",null],"defaultLanguage":"AR"}', '{"defaultLanguage":7}', "{broken", None, '{"supportedLanguages":"en"}', '{"defaultLanguage":"de"}']
    docs = spark.createDataFrame(list(enumerate(texts)), "flow_id int, definition string")
    assert rows(P.declared_languages(docs), "flow_id", "languages") == [(0, ("ar", "en-us")), (5, ("de",))]
    assert P.declared_languages(docs.limit(0)).count() == 0


def proof(pointer, field):
    return "sha256:" + hashlib.sha256(f"{pointer}\0{field}".encode()).hexdigest()


def test_caller_content(spark):
    lit = lambda text: {"config": {"lit": {"type": "str", "text": text}}}
    actions = [{"communication": lit("hi")}, {"communication": {"config": {"ref": {"type": "str", "val": "v"}}}}, {"question": lit("")}, {}, {"communication": lit("never")}, {"communication": lit("q"), "question": lit("r")}]
    docs = spark.createDataFrame([(1, json.dumps({"flowSequenceItemList": [{"actionList": actions}]})), (2, "{broken")], "flow_id int, definition string")
    node = spark.createDataFrame([(1, f"n{i}", f"/flowSequenceItemList/0/actionList/{i}", None, "DecisionAction" if i == 9 else "PlayAudioAction") for i in [*range(6), 9]], "flow_id int, node_id string, pointer string, name string, source_type string")
    use = spark.createDataFrame([(1, "n4", "b"), (1, "n4", "a"), (1, "n4", "a"), (1, "n4", "c"), (2, "n4", "a"), (1, "n9", "a")], "flow_id int, node_id string, prompt_id string")
    dep = spark.createDataFrame([(1, "a", "old", "/m/0"), (1, "a", "Alpha", "/m/1"), (1, "b", None, "/m/2")], "flow_id int, dependency_id string, display_name string, pointer string")
    out = {r.node_id: r for r in P.caller_content(node, use, dep, P.spoken_texts(docs)).collect()}
    assert {k: r.content for k, r in out.items()} == {
        "n0": 'inline TTS: "hi"', "n1": P.AT_RUNTIME, "n2": P.NO_TEXT, "n3": "—",
        "n4": "Alpha; b (no display name recorded); prompt c (unresolved in this capture)", "n5": 'inline TTS: "q r"',
    }
    own = [proof("/flowSequenceItemList/0/actionList/4", f) for f in ("name", "sourceType")]
    assert out["n4"].evidence_ids == sorted([*own, proof("/m/1", "reference"), proof("/m/2", "reference")])
    assert P.caller_content(node.limit(0), use, dep, P.spoken_texts(docs.limit(0))).count() == 0


CLAIM = "flow_id int, section int, claim_idx int, section_id string, text string, kind string, evidence_ids array<int>, subject_kind string, subject_id string"


def draft(spark, claims, **bounds):
    evidence = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "flow_id int, evidence_id int")
    corpus = spark.createDataFrame([(1, "the quick brown fox"), (1, None), (2, "elsewhere")], "flow_id int, text string")
    index = spark.createDataFrame([(1, 1, "node", "a"), (1, 2, "flow", "f")], "flow_id int, evidence_id int, kind string, id string")
    out = V.validate_draft(spark.createDataFrame(claims, CLAIM), evidence, corpus, index, **bounds)
    return {(r.flow_id, r.section, r.claim_idx): (r.failure, r.reported_idx) for r in out.collect()}


def test_first_failure_of_a_claim(spark):
    cases = [
        (None, "fact", [1], None, None, "malformed"), ("x", "guess", [1], None, None, "malformed"), ("x", "fact", None, None, None, "malformed"), ("x", "fact", [1, None], None, None, "malformed"),
        ("x", "fact", [1], "thing", "a", "malformed"), ("x" * 501, "fact", [], None, None, "too-large"), ("x " * 250, "fact", [1], None, None, None), ("https://a.b", "fact", [9], None, None, "forbidden-pattern"),
        ('"' + "y " * 61 + '"', "fact", [9], None, None, "quotation-too-long"), ("`quick blue`", "fact", [9], None, None, "quotation-not-in-corpus"), ("`elsewhere`", "fact", [1], None, None, "quotation-not-in-corpus"),
        ('`quick blue` and "' + "y " * 61 + '"', "fact", [1], None, None, "quotation-too-long"), ('““quick brown” “” ""', "fact", [1], None, None, "quotation-not-in-corpus"), ('“quick brown” “” ""', "fact", [1], None, None, None),
        ("x", "inference", [1, 3], None, None, "unknown-evidence"), ("x", "inference", [], None, None, "no-evidence"), ("x", "unknown", [], "node", "a", None), ("x", "inference", [1], "node", "b", "inference-not-allowed"),
        ("x", "fact", [2, 1, 1], "node", "a", None), ("x", "derived", [2], "node", "a", "unsupported-subject"), ("x", "fact", [2], "node", None, "unsupported-subject"), ("x", "fact", [2], "general", None, None), ("", "fact", [1], None, None, None),
    ]
    out = draft(spark, [(1, 0, i, "risks", *c[:5]) for i, c in enumerate(cases)])
    assert [out[1, 0, i][0] for i in range(len(cases))] == [c[5] for c in cases]


def test_budgets_of_sections_and_drafts(spark):
    ok = lambda section, i, n, name="risks": (1, section, i, name, "x" * n, "fact", [1], None, None)
    bad = lambda section, i: (1, section, i, "risks", None, "fact", [1], None, None)
    claims = [ok(0, 0, 5), bad(0, 1), ok(0, 2, 8), ok(0, 3, 5), bad(0, 4), ok(1, 0, 9, "appendix"), ok(1, 1, 9, "appendix"), ok(2, 0, 9), ok(2, 1, 1), ok(3, 0, 1), (1, 4, 0, None, "x", "fact", [1], None, None)]
    out = draft(spark, claims, section_claims=2, section_chars=12, draft_claims=3, draft_chars=12)
    assert out == {
        (1, 0, 0): (None, 0), (1, 0, 1): ("malformed", 1), (1, 0, 2): ("section-too-large", 2), (1, 0, 3): (None, 3), (1, 0, 4): ("section-too-large", 4),
        (1, 1, None): ("section-not-allowed", None), (1, 2, 0): ("draft-too-large", 0), (1, 2, 1): (None, 1), (1, 3, 0): ("draft-too-large", 0), (1, 4, None): ("section-not-allowed", None),
    }
    assert draft(spark, []) == {}


def test_completeness_and_dependencies(spark):
    node = spark.createDataFrame([(1, "a", "full", "DataAction"), (1, "b", "opaque", "Menu"), (1, "c", "unsupported", None), (1, "c", None, "DataAction"), (2, "a", "partial", "Menu")], "flow_id int, node_id string, support_level string, source_type string")
    edge = spark.createDataFrame([(1, "a", "b"), (1, "a", "gone"), (1, "gone", "c"), (1, None, "c"), (1, "a", "c"), (3, "a", "a")], "flow_id int, src string, dst string")
    dep = spark.createDataFrame([(1, "d", "dataAction", None, "resolved", "/p"), (1, "e", "dataAction", "E", None, "/q"), (1, "f", "queue", "F", "not-found", "/r")], "flow_id int, dependency_id string, type string, display_name string, status string, pointer string")
    counts = ("source_objects", "represented", "unsupported", "opaque", "dangling_edges", "unresolved_dependencies")
    assert rows(R.completeness(node, edge, dep), "flow_id", *counts) == [(1, 4, 3, 1, 1, 3, 2), (2, 1, 1, 0, 0, 0, 0)]
    flow = spark.createDataFrame([(1, "one", "t"), (3, None, None)], "flow_id int, name string, type string")
    assert rows(R.identity(flow, R.completeness(node, edge, dep)), "flow_id", "name", "name_evidence", "source_objects") == [(1, "one", proof("/name", "name"), 4), (3, None, proof("/name", "name"), None)]
    ref = spark.createDataFrame([(1, "d", "a"), (1, "d", "a"), (1, "d", "b"), (2, "d", "a")], "flow_id int, dependency_id string, node_id string")
    assert rows(R.dependency_table(dep, ref), "dependency_id", "label", "referenced_by", "evidence_id") == [("d", "d", 2, proof("/p", "reference")), ("e", "E", 0, proof("/q", "reference")), ("f", "F", 0, proof("/r", "reference"))]
    assert rows(R.outside_calls(flow, node, dep), "flow_id", "calling_nodes", "dependencies", "unresolved") == [(1, 2, 2, 1), (3, 0, 0, 0)]
    assert R.completeness(node.limit(0), edge, dep).count() == 0


def test_inspection_bounds_its_lists(spark):
    flow = spark.createDataFrame([(1,), (2,)], "flow_id int")
    node = spark.createDataFrame([(1, "a"), (1, "b")], "flow_id int, node_id string")
    edge = spark.createDataFrame([(1, "a", "b")], "flow_id int, src string, dst string")
    dep = spark.createDataFrame([(1, "queue"), (1, "queue"), (1, "flow")], "flow_id int, type string")
    journey = spark.createDataFrame([(1, "loop", ["b"]), (1, "dead-end", ["a", "b"]), (1, "dead-end", ["a"])], "flow_id int, kind string, steps array<string>")
    warning = spark.createDataFrame([(1, "Z", "last of the capture"), (1, "A", "first")], "flow_id int, code string, message string")
    found = spark.createDataFrame([(1, "B", "error", "bad"), (1, "B", "info", "never told"), (1, "C", "critical", "cut off")], "flow_id int, code string, severity string, message string")
    out = {r.flow_id: r for r in R.inspection(flow, node, edge, dep, journey, warning, found, paths=2, messages=3).collect()}
    assert (out[1].nodes, out[1].edges, [tuple(x) for x in out[1].dependency_counts]) == (2, 1, [("flow", 1), ("queue", 2)])
    assert out[1].main_paths == ["a (dead-end)", "a -> b (dead-end)"] and out[1].warnings == ["first", "last of the capture", "bad"]
    assert (out[2].nodes, out[2].edges, out[2].dependency_counts, out[2].main_paths, out[2].warnings) == (0, 0, [], [], [])
