"""Hand-made graphs, diffs, texts and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from flowlake.functions import text as X
from flowlake.operators import diff as D
from flowlake.operators import graph as G
from flowlake.operators import grounding as V
from flowlake.operators import incremental as C
from flowlake.operators import normalize as N
from flowlake.operators import quality as I
from flowlake.operators import resources as R
from flowlake.sources import bundles as S
from flowlake.streaming import changes as T

NODE = "flow_id string, node_id string, source_type string, name string, support_level string"
EDGE = "flow_id string, edge_id string, src string, dst string, role string, label string"
CASES = {  # nodes, edges, entries
    "chain": ("abc", ["ab", "bc"], "a"), "orphan": ("abx", ["ab"], "a"), "two": ("ab", ["ab", "ba"], "a"), "self": ("ab", ["aa", "ab"], "a"),
    "both": ("abcd", ["ab", "ba", "cd", "dc"], "a"), "diamond": ("abcd", ["ab", "ac", "bd", "cd"], "a"), "gone": ("a", ["az", "ya"], "a"), "none": ("ab", ["ab"], ""),
}


@pytest.fixture(scope="module")
def graph(spark):
    kinds = {"d": "TransferToAcdAction", "c": "DisconnectAction"}
    node = [(f, n, kinds.get(n, "PlayAction"), f"N {n}", "full") for f, (ns, _, _) in CASES.items() for n in ns]
    edge = [(f, f"e{i}", a, b, "next", None) for f, (_, es, _) in CASES.items() for i, (a, b) in enumerate(es)]
    entry = [(f, n) for f, (_, _, es) in CASES.items() for n in es]
    return spark.createDataFrame(node, NODE), spark.createDataFrame(edge, EDGE), spark.createDataFrame(entry, "flow_id string, node_id string")


def by_flow(df, *columns):
    out = {}
    for r in df.select("flow_id", *columns).collect():
        out.setdefault(r[0], []).append(tuple(r)[1:] if len(columns) > 1 else r[1])
    return {k: sorted(v) for k, v in out.items()}


def test_reachability(graph):
    assert {f: "".join(v) for f, v in by_flow(G.reachability(*graph), "node_id").items()} == {"chain": "abc", "orphan": "ab", "two": "ab", "self": "ab", "both": "ab", "diamond": "abcd", "gone": "a"}


def test_dangling_and_terminal(graph):
    node, edge, _ = graph
    assert by_flow(G.dangling_edges(node, edge), "edge_id") == {"gone": ["e0"]}  # a missing source alone is none
    assert by_flow(G.terminal_nodes(node, edge), "node_id") == {"chain": ["c"], "orphan": ["b", "x"], "self": ["b"], "diamond": ["d"], "gone": ["a"], "none": ["b"]}


def test_components(graph):
    node, edge, _ = graph
    assert by_flow(G.strongly_connected_components(node, edge), "nodes") == {"two": [["a", "b"]], "self": [["a"]], "both": [["a", "b"], ["c", "d"]]}


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    node, edge = [], []
    for f in range(6):
        node += [(str(f), str(n), "", "", "") for n in range(8)]
        edge += [(str(f), str(i), str(rng.randrange(8)), str(rng.randrange(8)), "", "") for i in range(11)]
    got = by_flow(G.strongly_connected_components(spark.createDataFrame(node, NODE), spark.createDataFrame(edge, EDGE)), "nodes")
    for f in range(6):
        paths = {(e[2], e[3]) for e in edge if e[0] == str(f)}
        while True:
            more = paths | {(a, d) for a, b in paths for c, d in paths if b == c}
            if more == paths:
                break
            paths = more
        want = {tuple(sorted({b for a, b in paths if a == n and (b, a) in paths})) for n in map(str, range(8)) if (n, n) in paths}
        assert {tuple(x) for x in got.get(str(f), [])} == want


@pytest.mark.parametrize("cap", [None, 50])
def test_journeys(graph, cap):
    got = by_flow(G.journeys(*graph, max_journeys=cap).withColumn("steps", F.array_join("steps", "")), "kind", "steps")
    assert got == {
        "chain": [("disconnect", "abc")], "orphan": [("dead-end", "ab")], "two": [("loop", "aba")], "self": [("dead-end", "ab"), ("loop", "aa")],
        "both": [("loop", "aba")], "diamond": [("disconnect", "ac"), ("transfer", "abd")], "gone": [("dead-end", "a")],
    }
    assert all(len(v) == 1 for v in by_flow(G.journeys(*graph, max_journeys=1), "kind").values())
    assert by_flow(G.journeys(*graph, max_depth=2, max_journeys=cap), "kind")["chain"] == ["truncated"]


def test_diff_of_itself_and_mirror(spark):
    a = spark.createDataFrame([("f", "1", "x", ["p", "q"]), ("f", "2", None, [])], "flow_id string, k string, v string, s array<string>")
    b = spark.createDataFrame([("f", "1", "x", ["q", "p"]), ("f", "3", "z", None)], a.schema)
    ops = lambda x, y: {r.k: r.op for r in D.diff(x, y, ["flow_id", "k"], ["v"], ["s"]).collect()}
    assert set(ops(a, a).values()) == {"same"}
    assert ops(a, b) == {"1": "same", "2": "removed", "3": "added"} and ops(b, a) == {"1": "same", "2": "added", "3": "removed"}


def test_closure_with_cycle_and_missing(spark):
    node = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t")], "key string, type string")
    edge = spark.createDataFrame([("a", "b", ""), ("b", "a", ""), ("b", "m", ""), ("m", "c", "")], "src string, dst string, via string")
    got = {r.key: (r.status, r.depth) for r in R.reference_closure(node.where("key = 'a'"), node, edge).collect()}
    assert got == {"a": ("resolved", 0), "b": ("resolved", 1), "m": ("not_found", 2)}


def test_texts(spark):
    df = spark.createDataFrame([("a\x00b​c <b>", "https://u:p@h/x", "Foo Bar_baz", 'x "q1" `q2`'), ("", "plain", "con", "")], "t string, u string, n string, q string")
    r = df.select(X.strip_invisible(X.strip_control(F.col("t"))), X.strip_url_credentials(F.col("u")), X.safe_segment(F.col("n")), X.quotations(F.col("q")), X.forbidden_pattern(F.col("t"))).collect()
    assert tuple(r[0]) == ("abc <b>", "https://h/x", "Foo-Bar_baz", ["q1", "q2"], "CONTROL_CHARACTER")
    assert tuple(r[1]) == ("", "plain", "con-", [], None)


def test_greedy_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 9, 3, 2, 1])], "k string, i long, n long")
    assert [r.i for r in V.greedy_budget(df, ["k"], "i", "n", 3, 10).where("kept").orderBy("i").collect()] == [0, 2, 3]


def test_bundle_hash_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert I.table_hash(df).first() == I.table_hash(df.orderBy(F.desc("x"))).first() != I.table_hash(df.limit(1)).first()


def test_flatten_escapes_and_skips(spark):
    docs = spark.createDataFrame([("f", json.dumps({"a/b": [{"~": 1}, "x"], "n": None})), ("g", "{oops")], "flow_id string, definition string")
    got = {r.pointer: (r.type, r.scalar) for r in N.flatten_json(docs).collect()}
    assert got["/a~1b/0/~0"][1] == "1" and got["/a~1b/1"] == ("STRING", "x") and got[""][0] == "OBJECT" and len(got) == 6
    assert [r.flow_id for r in N.unparsable(docs).collect()] == ["g"]


def test_bundles(spark, tmp_path):
    for f, v, name, text in (("f1", "1", "definition.json", "{}"), ("f2", "3", "definition.json", "{bad"), ("f3", "1", "definition.yaml", "a: 1")):
        at = tmp_path / "b" / "flows" / f / "versions" / v
        at.mkdir(parents=True)
        (at / name).write_text(text)
        (at.parent.parent / "flow.json").write_text("{}")
    (tmp_path / "b" / "flows" / "f4").mkdir()
    (tmp_path / "b" / "flows" / "f4" / "flow.json").write_text("{}")
    flows, skipped = S.read_bundle_flows(spark, str(tmp_path / "b"))
    assert [(r.flow_id, r.version) for r in flows.collect()] == [("f1", "1")]
    assert {r.flow_id: r.reason for r in skipped.collect()} == {"f2": "definition-unreadable", "f3": "format-unsupported", "f4": "definition-missing"}
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"key": "q:1", "type": "q", "id": "1", "displayName": "Q", "resolutionStatus": "resolved"}], "edges": [{"from": "q:1", "to": "q:2", "viaNodeId": None, "viaField": "x"}]}))
    node, edge = S.read_resource_graph(spark, str(tmp_path / "g.json"))
    assert node.first().status == "resolved" and edge.first().dst == "q:2"
    assert S.read_assets(spark, str(tmp_path / "b")).count() == 7


def test_streams_agree_with_batch(spark, tmp_path):
    previous = spark.createDataFrame([(1, 1, "d", "h"), (2, 1, "d", "h")], "flow_id long, version long, division string, hash string")
    found = spark.createDataFrame([(1, "found", 1, "d", "h"), (2, "found", 2, "d", "g"), (3, "found", 1, "d", "h")], "flow_id long, status string, version long, division string, hash string")
    found.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(found.schema).parquet(str(tmp_path / "in"))
    T.stream_flow_changes(stream, previous, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = {(r.flow_id, r.action) for r in C.decide(previous, found).collect()}
    assert {(r.flow_id, r.action) for r in spark.read.parquet(str(tmp_path / "out" / "decisions")).collect()} == want
    runs = spark.range(8).select((F.col("id") % 2).alias("flow_id"), F.timestamp_seconds(F.col("id") * 3600 + 1).alias("run"), (F.col("id") >= 4).alias("absent"))
    runs.coalesce(1).write.parquet(str(tmp_path / "runs"))
    out = T.stream_retire_confirmation(spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs")))
    q = out.writeStream.format("memory").queryName("retired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.flow_id, r.run) for r in spark.sql("SELECT * FROM retired").collect()} == {(r.flow_id, r.run) for r in C.confirm_retired(runs).collect()}


def test_deep_values_and_references_are_kept(spark):
    doc = json.dumps("end")
    for _ in range(80):
        doc = '{"k":' + doc + "}"
    rows = N.flatten_json(spark.createDataFrame([("f", doc)], "flow_id string, definition string"))
    assert rows.agg({"depth": "max"}).first()[0] == 80 and rows.where("scalar = 'end'").count() == 1
    node = spark.createDataFrame([(f"n{i}", "t") for i in range(5)], "key string, type string")
    edge = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "") for i in range(4)], "src string, dst string, via string")
    got = {r.key: (r.depth, r.truncated) for r in R.reference_closure(node.where("key = 'n0'"), node, edge, max_depth=2).collect()}
    assert got == {"n0": (0, False), "n1": (1, False), "n2": (2, True)}


def test_branch_roles_and_notes(spark):
    from flowlake.operators import incremental as C

    df = spark.createDataFrame([("__YES__", False), ("__DEFAULT__", False), ("Plain", False), ("____", True), ("____", False), (None, True), ("0B7A1C22-aaaa-4bbb-8ccc-0123456789ab", False)], "o string, d boolean")
    assert [r[0] for r in df.select(N.branch_role(df.o, df.d)).collect()] == ["yes", "default", "plain", "dynamic-branch", "branch", "dynamic-branch", "branch"]
    old = spark.createDataFrame([(1, None, "a", "x"), (2, "d", "a", None), (3, "d", "a", "x")], "flow_id int, division string, type string, name string")
    new = spark.createDataFrame([(1, "d", "a", "x"), (2, "d", "b", "y"), (3, "d", "a", "z"), (4, "d", "a", "z")], "flow_id int, division string, type string, name string")
    assert {r.flow_id: r.notes for r in C.metadata_notes(old, new).collect()} == {1: ["DIVISION_CHANGED"], 2: ["TYPE_CHANGED"], 3: ["DISPLAY_NAME_CHANGED"]}


def test_redaction_takes_whole_subtrees(spark):
    doc = json.dumps({"Pass-word": {"a": ["b"]}, "x": [{"cookie": "[REDACTED:authorization]", "y": "https://u@h/"}], "token": "t"})
    rows = X.redact(N.flatten_json(spark.createDataFrame([("f", doc)], "flow_id string, definition string"))).where("value is not null")
    assert {r.pointer: (r.value, r.category) for r in rows.collect()} == {
        "/Pass-word": ("[REDACTED:password]", "password"), "/x/0/cookie": ("[REDACTED:authorization]", None), "/x/0/y": ("https://h/", "url-credential"), "/token": ("t", None)
    }
