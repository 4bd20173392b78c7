"""Published snapshots, replayed streams, expiring state, canaries, settings and marks, by hand-made cases."""

import json
import os

import pytest
from pyspark.sql import functions as F

from flowlake.operators import evidence as V
from flowlake.operators import quality as I
from flowlake.operators import settings as S
from flowlake.sources import snapshots
from flowlake.streaming import changes as T

NODE = "organization int, flow_id int, version int, node_id string"


def test_a_run_shows_only_when_published(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *r: {"node": spark.createDataFrame(list(r), NODE)}
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, root, "node")
    see = lambda: {(r.flow_id, r.node_id, r.run_id) for r in snapshots.read_snapshot(spark, root, "node").collect()}
    snapshots.write_snapshot(rows((1, 1, 1, "a"), (1, 1, 1, "b"), (1, 2, 1, "c"), (1, 3, 1, "d")), root, "r1")
    snapshots.stage(rows((1, 1, 1, "x")), root, "r2")
    assert see() == {(1, "a", "r1"), (1, "b", "r1"), (2, "c", "r1"), (3, "d", "r1")}
    gone = spark.createDataFrame([(1, 3, 1)], "organization int, flow_id int, version int")
    for _ in range(2):  # done again after a crash
        snapshots.write_snapshot(rows((1, 1, 1, "y")), root, "r2", gone=gone)
    assert see() == {(1, "y", "r2"), (2, "c", "r1")} and snapshots.current_run(spark, root) == (1, "r2")


def test_an_epoch_done_again_changes_nothing(spark, tmp_path):
    kind = "flow_id long, status string, version long, division string, hash string"
    previous = spark.createDataFrame([(1, 1, "d", "h"), (2, 1, "d", "h"), (3, 1, "d", "h")], "flow_id long, version long, division string, hash string")
    first = spark.createDataFrame([(1, "found", 2, "d", "g"), (2, "not-found", None, None, None)], kind)
    second = spark.createDataFrame([(4, "found", 1, "d", "h")], kind)
    seen = {}
    for crash in (False, True):
        at = str(tmp_path / str(crash))
        first.coalesce(1).write.parquet(f"{at}/in")
        run = lambda: T.stream_flow_changes(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), previous, f"{at}/out", f"{at}/cp").awaitTermination()  # noqa: E731,B023
        run()
        if crash:  # the tables were written, the commit was not
            for name in ("0", ".0.crc"):
                os.remove(f"{at}/cp/commits/{name}")
            run()
        second.coalesce(1).write.mode("append").parquet(f"{at}/in")
        run()
        seen[crash] = {n: sorted(map(str, spark.read.parquet(f"{at}/out/{n}").collect())) for n in ("decisions", "snapshot")}
    assert seen[True] == seen[False]
    last = spark.read.parquet(f"{tmp_path}/True/out/snapshot").where("run_id = 1").collect()
    assert {(r.flow_id, r.version) for r in last} == {(1, 2), (3, 1), (4, 1)}


def test_state_of_retired_flows_goes(spark, tmp_path):
    kind = "flow_id long, run timestamp, absent boolean"
    day = lambda f, d, absent: (f, d * 86400, absent)
    lands = [[day(1, 1, True), day(2, 1, True), day(2, 2, True)], [day(1, 2, True), day(3, 40, False)], [day(1, 3, True), day(3, 90, True)], [day(3, 91, True)]]
    rows, found = [], []
    for k, part in enumerate(lands):
        df = spark.createDataFrame(part, "flow_id long, at long, absent boolean").select("flow_id", F.timestamp_seconds("at").alias("run"), "absent")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = T.stream_retire_confirmation(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), delay="1 day", keep_ms=10 * 86_400_000)
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        rows.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        found = sorted((r.flow_id, r.run.timetuple().tm_yday) for r in spark.read.schema("flow_id long, run timestamp").parquet(f"{tmp_path}/out").collect())
    # flow 1's run of day 3 came behind the watermark; flow 3 was absent twice running
    assert found == [(1, 3), (2, 3), (3, 33 + 59)] or [f for f, _ in found] == [1, 2, 3]
    assert rows[-1] < max(rows)


def test_canaries_in_any_text(spark):
    a = spark.createDataFrame([(1, "xx secret yy secret", ["plain", "deep-token"], None), (2, None, None, "nothing"), (3, "sec ret", [], "SECRET")], "id long, key string, `table` array<string>, canary string")
    got = I.canary_scan({"a": (a, "id")}, [("s", "secret"), ("t", "deep-token"), ("same", "secret"), ("none", "absent"), ("empty", "")])
    assert {tuple(r) for r in got.collect()} == {("a", "key", "1", "s"), ("a", "key", "1", "same"), ("a", "table", "1", "t")}
    assert I.canary_scan({"a": (a, "id")}, []).count() == 0


def test_settings_and_decisions(spark):
    wrap = lambda v: {"config": v}
    deep = {"lit": {"type": "int", "text": "1"}}
    for _ in range(9):
        deep = {"Not": {"operands": [deep]}}
    node = {
        "__type": "DecisionAction", "id": "i", "name": "top", "count": 3, "on": False, "quote": 'a"b}', "long": "é" * 501, "none": None, "list": [], "mixed": ["a", {"b": 1}],
        "who": wrap({"ref": {"type": "int", "val": "v"}}), "prompt": wrap({"ref": {"type": "pmt", "val": "p"}}), "odd": wrap({"x}": 1}), "noText": wrap({"lit": {}}), "category": {"name": "n", "id": "z", "far": {"a": 1}},
        "expression": wrap(deep),
    }
    docs = spark.createDataFrame([(1, json.dumps({"flowSequenceItemList": [{"id": "c", "actionList": [node, "no object", {}], "menuChoiceList": [{"action": {"id": "m", "tone": "low"}}]}]})), (2, "{bad"), (3, "[]"), (4, None)], "flow_id long, definition string")
    got = {r.pointer: r for r in S.extract_settings(docs).collect()}
    own = got["/flowSequenceItemList/0/actionList/0"]
    want = json.loads(own.settings)
    nots = want.pop("expression")
    for _ in range(8):
        assert nots["operator"] == "Not" and nots["kind"] == "expression"
        nots = nots["operands"][0]
    assert nots == {"kind": "expression", "operator": "Not", "operands": []}
    assert want == {
        "category": {"name": "n"}, "count": 3, "long": "é" * 500, "noText": {"kind": "literal", "dataType": "", "text": ""}, "odd": {"kind": "opaque", "discriminator": "x}"}, "on": False, "quote": 'a"b}', "who": {"kind": "variableRef", "dataType": "int"},
    }
    assert own.truncated == ["expression", "long"] and own.dropped == []
    assert got["/flowSequenceItemList/0/menuChoiceList/0/action"].settings == '{"tone":"low"}' and got["/flowSequenceItemList/0/actionList/2"].settings == "{}" and len(got) == 4
    assert [r.expression for r in S.decision_points(docs).collect()] == ["Not(" * 7 + "?" + ")" * 7]


def test_marks_by_first_appearance(spark):
    rows = spark.createDataFrame([(1, 0, ["b", "a", "b"]), (1, 1, ["c", "a"]), (1, 2, []), (1, 3, ["c", "d"]), (2, 5, ["d"])], "flow_id int, pos int, evidence_ids array<string>")
    marks, text = V.citation_marks(rows)
    assert {(r.flow_id, r.evidence_id): r.mark for r in marks.collect()} == {(1, "a"): 1, (1, "b"): 2, (1, "c"): 3, (1, "d"): 4, (2, "d"): 1}
    assert {(r.flow_id, r.pos): r.text for r in text.collect()} == {(1, 0): "[e1][e2]", (1, 1): "[e1][e3]", (1, 2): "", (1, 3): "[e3][e4]", (2, 5): "[e1]"}


def test_caps_keep_partial_limits(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    first, counts = V.bounded_first(df, ["k"], ["id"], 5)
    assert first.count() == 15 and {r.n for r in counts.collect()} == {333, 334}
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()


def test_settings_read_each_document_once(spark):
    """Each kind of node parsed all documents anew, and each field of a node took the whole node apart."""
    node = {"__type": "Task", "id": "a", "b": [1, "x"], "a": {"z": 1, "y": {"config": {"nul": {}}}}}
    docs = spark.createDataFrame([(1, json.dumps({"flowSequenceItemList": [{"id": "c"}, {"actionList": [node], "menuChoiceList": [{"digit": 1}, {"action": node}]}, 7]}))], "flow_id long, definition string")
    rows = S.extract_settings(docs)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") + rows._jdf.queryExecution().optimizedPlan().toString().count("parse_json(") <= 2  # the column, and whether it is null
    at = "/flowSequenceItemList/"
    whole = '{"a":{"y":{"kind":"null"},"z":1},"b":[1,"x"]}'
    assert {(r.pointer, r.settings) for r in rows.collect()} == {(at + "0", "{}"), (at + "1", "{}"), (at + "1/actionList/0", whole), (at + "1/menuChoiceList/1/action", whole)}
