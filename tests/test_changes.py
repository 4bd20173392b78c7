"""Version changes, canonical text, edges and grounding on small tables made by hand, empty ones and nulls included."""

import pytest

from flowlake.functions import text as X
from flowlake.operators import canonical as J
from flowlake.operators import changes as S
from flowlake.operators import edges as E
from flowlake.operators import grounding as V
from flowlake.operators import normalize as N

NODE = "flow_id int, node_id string, tracking_id string, name string, container_path array<string>, source_type string, support_level string, variable_reads array<string>, variable_writes array<string>, dependency_refs array<string>, prompt_refs array<string>, settings map<string,string>"
EDGE = "flow_id int, edge_id string, src string, role string, dst string, condition string, label string"
VARIABLE = "flow_id int, variable_id string, name string, scope string, data_type string, direction string, secure boolean, read_node_ids array<string>, write_node_ids array<string>"
DEPENDENCY = "flow_id int, dependency_id string, type string, display_name string, status string, referenced_by array<string>"
FLOW = "flow_id int, name string, description string, type string, secure boolean, division_id string, division_name string, languages array<string>, selected string, state string, published string, latest_checked_in string, graph_hash string"
TABLES = {"flow": FLOW, "node": NODE, "edge": EDGE, "variable": VARIABLE, "dependency": DEPENDENCY, "entry": "flow_id int, node_id string", "warning": "flow_id int, code string, severity string, evidence_ids array<string>"}


def changes(spark, **pairs):
    """The changes of pairs of row lists; collections not named are empty."""
    made = {n: tuple(spark.createDataFrame(rows, schema) for rows in pairs.get(n, ([], []))) for n, schema in TABLES.items()}
    return sorted(tuple(r)[1:5] for r in S.semantic_changes(**made).collect())


def node(**over):
    row = dict(flow_id=1, node_id="a", tracking_id="1", name="x", container_path=["c"], source_type="Task", support_level="full", variable_reads=["u", "v"], variable_writes=[], dependency_refs=None, prompt_refs=[], settings={"k": "1", "expression": "e"})
    return tuple((row | over).values())


def test_nothing_changes_nothing(spark):
    assert changes(spark) == []
    assert changes(spark, node=([node()], [node(variable_reads=["v", "u"], settings={"expression": "e", "k": "1"})])) == []


@pytest.mark.parametrize("over, want", [
    ({"name": "y"}, [("action-changed", "changed", "a", "relabeled")]),
    ({"name": None, "variable_reads": ["u"]}, [("action-changed", "changed", "a", "reconfigured")]),
    ({"variable_reads": ["u", "v", "v"]}, [("action-changed", "changed", "a", "reconfigured")]),
    ({"support_level": "opaque"}, [("coverage-changed", "changed", "a", None)]),
    ({"support_level": "novel"}, []),
    ({"settings": {"k": "2", "expression": "e"}}, [("action-changed", "changed", "a", "reconfigured")]),
    ({"settings": {"k": "2", "expression": "f"}}, [("condition-expression-changed", "changed", "a", None)]),
    ({"settings": None}, [("condition-expression-changed", "changed", "a", None)]),
    ({"prompt_refs": ["p"]}, [("action-changed", "changed", "a", "reconfigured"), ("prompt-reference-changed", "changed", "a", None)]),
    ({"node_id": "b"}, [("action-changed", "added", "b", "presence"), ("action-changed", "removed", "a", "presence")]),
])
def test_node_changes(spark, over, want):
    assert changes(spark, node=([node()], [node(**over)])) == want


def test_edges_pair_only_in_clear_slots(spark):
    side = lambda rows: spark.createDataFrame([(1, *r) for r in rows], EDGE)
    before = side([("e1", "a", "yes", "b", "c1", "l"), ("e2", "a", "no", "b", None, None), ("e3", "a", "no", "c", None, None), ("e5", "a", "next", "b", None, "old")])
    after = side([("e4", "a", "yes", "c", "c2", "l"), ("e6", "a", "no", "d", None, None), ("e5", "a", "next", "b", None, "new")])
    have = sorted((r.op, r.before_id or "", r.after_id or "", tuple(r.fields)) for r in S.edge_changes(before, after).collect())
    assert have == [("added", "", "e6", ()), ("changed", "e1", "e4", ("dst", "condition")), ("changed", "e5", "e5", ("label",)), ("removed", "e2", "", ()), ("removed", "e3", "", ())]


def test_entries_and_warnings(spark):
    assert changes(spark, node=([node()], [node()]), entry=([(1, "a")], [(1, "a"), (1, "gone")])) == [("entry-point-changed", "added", "gone", None)]
    assert changes(spark, entry=([(1, "a")], [(1, "a")])) == [("entry-point-changed", "added", "a", None), ("entry-point-changed", "removed", "a", None)]
    new = [(1, "VALUE_OPAQUE", "info", ["2", "1"]), (1, "EDGE_DANGLING", "info", []), (1, "LOW_COVERAGE", "info", ["3"])]
    assert changes(spark, warning=([(1, "VALUE_OPAQUE", "info", ["1", "2"])], new)) == [("coverage-changed", "added", None, None)]


def test_canonical_text(spark):
    docs = spark.createDataFrame([(1, '{"b":[2,10,"x"],"a":{"selfUri":1,"k":"cafe\\u0301"}}'), (2, "{broken"), (3, None), (4, "[]"), (5, '"t"')], "flow_id int, definition string")
    have = {r.flow_id: r.canonical for r in J.canonicalize(N.flatten_json(docs)).collect()}
    assert have == {1: '{"v":"1","d":{"a":{"k":"café"},"b":["x",10,2]}}', 4: '{"v":"1","d":[]}', 5: '{"v":"1","d":"t"}'}
    assert J.canonicalize(N.flatten_json(docs.where("flow_id > 9"))).count() == 0


def test_edges_of_empty_and_broken_documents(spark):
    for rows in ([], [(1, "{}"), (2, "{broken"), (3, '{"flowSequenceItemList":[1,{"id":7},{"id":"c","startAction":"","paths":[3,{}]}]}')]):
        paths = N.flatten_json(spark.createDataFrame(rows, "flow_id int, definition string"))
        edges, warnings = E.extract_edges(paths, N.extract_nodes(paths), N.extract_dependencies(paths))
        assert edges.count() == 0 and warnings.count() == 0


def test_bytes_are_cut_between_characters(spark):
    texts = ["", "abc", "aé€😀z", "😀😀", None]
    for most in range(0, 12):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.bounded_bytes(spark_col("t"), most).alias("t")).collect()
        for r in rows:
            want = texts[r.i] and texts[r.i].encode()[:most].decode("utf-8", "ignore")
            assert r.t == want, (most, texts[r.i])


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_subjects_and_unknowns(spark):
    index = V.subject_index(spark.createDataFrame([(1, 1, "node", "a"), (1, 1, "node", "a"), (1, 2, "flow", "f")], "flow_id int, evidence_id int, kind string, id string"))
    assert index.count() == 2
    claim = spark.createDataFrame([(1, 0, [2, 1], "node", "a"), (1, 1, [2], "node", "a"), (1, 2, None, "flow", "f"), (1, 3, [], "flow", "f"), (2, 0, [1], "node", "a")], "flow_id int, claim_idx int, evidence_ids array<int>, subject_kind string, subject_id string")
    assert sorted((r.flow_id, r.claim_idx, r.supported) for r in V.subject_supported(claim, index).collect()) == [(1, 0, True), (1, 1, False), (1, 2, False), (1, 3, False), (2, 0, False)]
    unknown = spark.createDataFrame([(1, 0, None), (1, 1, "ok"), (1, 2, "see https://x.y"), (1, 3, "ok too"), (1, 4, None), (2, 0, "x" * 501)], "flow_id int, idx int, text string")
    have = [r.failure for r in V.validate_unknowns(unknown, most=2).orderBy("flow_id", "idx").collect()]
    assert have == ["malformed", None, "forbidden-pattern", None, "draft-too-large", "too-large"]
