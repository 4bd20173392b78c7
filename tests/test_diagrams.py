"""Diagrams at the size of a part, labels, ranks of a hot group, and the census of odd documents."""

import random

from pyspark.sql import functions as F

from flowlake.operators import census as S
from flowlake.operators import diagrams as P
from flowlake.operators import normalize as N

NODE = "flow_id string, node_id string, name string, container array<string>"
EDGE = "flow_id string, src string, dst string, label string"


def test_size_of_a_part(spark):
    rows = [("fits", f"n{i:02}", f"N {i}", ["t"] * (i % 2)) for i in range(30)]
    rows += [("more", f"n{i:02}", f"N {i}", None if i == 0 else [] if i < 3 else ["b"] if i < 40 else ["a", "x"]) for i in range(45)]
    flow = spark.createDataFrame([("fits", "F"), ("more", "M" * 50), ("empty", "E")], "flow_id string, name string")
    edge = spark.createDataFrame([("more", "n00", "n01", "yes"), ("more", "n02", "n03", "across"), ("more", "n03", "n33", "parts"), ("fits", "n00", "n29", ""), ("fits", "n00", "gone", None)], EDGE)
    nodes = P.diagram_nodes(flow, spark.createDataFrame(rows, NODE))
    edges = P.diagram_edges(nodes, edge)
    assert sorted(tuple(r) for r in edges.collect()) == [("fits", "flow", 1, 30, None), ("more", "diagram-3", 1, 2, "yes")]
    cyclic = spark.createDataFrame([("more", "n41"), ("more", "n40")], "flow_id string, node_id string")
    got = {(r.flow_id, r.diagram_id): (r.title, len(r.node_ids), r.cyclic_ids, r.edges) for r in P.diagrams(nodes, edges, cyclic).collect()}
    assert got == {
        ("fits", "flow"): ("F", 30, [], 1),
        ("more", "diagram-1"): ("a / x", 5, ["n40", "n41"], 0),
        ("more", "diagram-2-part-1"): ("b (part 1 of 2)", 30, [], 0),
        ("more", "diagram-2-part-2"): ("b (part 2 of 2)", 7, [], 0),
        ("more", "diagram-3"): ("M" * 39 + "…", 3, [], 1),
    }
    assert P.diagram_nodes(flow, spark.createDataFrame([], NODE)).count() == 0


def test_labels(spark):
    cases = {'a --> "b"': "a -to- 'b'", "x %% y ==> z --- {q} [r]": "x pct-pct y -to- z - (q) (r)", "one\r\ntwo\nthree\x07": "one two three", "é" * 41: "é" * 39 + "…", "": ""}
    rows = spark.createDataFrame(list(cases.items()), "text string, want string").withColumn("have", P.diagram_label(F.col("text")))
    assert rows.where("want <> have").collect() == []


def test_ranks_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(40)}", i) for i in rng.sample(range(100000), 4000)]
    frame = spark.createDataFrame(rows, "k string, v long")
    got = {(r.k, r.v): r["rank"] for r in P.ranked(frame, ["k"], "v").collect()}
    place = {}
    for k, v in sorted(rows):
        place[k] = place.get(k, 0) + 1
        assert got[k, v] == place[k]
    assert len(got) == 4000


def test_census(spark):
    docs = [
        ("none", '{"manifest":{"queue":[],"odd":1}}'),
        ("broken", "{"),
        ("all", '{"flowSequenceItemList":[{"__type":"Task","trackingId":1,"actionList":[{"__type":"New","trackingId":2,"x":{"config":{"lit":{}}}}],"menuChoiceList":[{"action":{"trackingId":3}},{"action":null},{}]},null,7]}'),
        ("loose", '{"flowSequenceItemList":[{"__type":"Menu","deep":[{"a":{"config":{"zz":{"config":{"yy":1}}}}}],"config":"text"}]}'),
        ("blank", '{"flowSequenceItemList":[]}'),
        ("object", '{"flowSequenceItemList":{"0":{}}}'),
    ]
    flow = spark.createDataFrame([(k, "t") for k, _ in docs], "flow_id string, type string")
    paths = N.flatten_json(spark.createDataFrame(docs, "flow_id string, definition string"))
    row = S.corpus_census(flow, paths).collect()
    assert [tuple(r) for r in row] == [("t", 6, 3, 4, 3, 2)]
    got = sorted(tuple(r) for r in S.unknown_names(flow, paths).collect())
    assert got == [("t", "manifest key", "odd", 1, 1), ("t", "node type", "New", 1, 1), ("t", "node type", "UNKNOWN", 1, 1), ("t", "wrapper", "yy", 1, 1), ("t", "wrapper", "zz", 1, 1)]
