"""Rows of objects carry their scalar members, so that extractors neither join nor gather them."""

from flowlake.operators import edges as E
from flowlake.operators import normalize as N
from flowlake.operators.canonical import pseudonymize

DOC = '{"a":{"s":"x","i":7,"b":true,"n":1.50,"v":null,"o":{},"l":[{"s":"y"},[]]},"manifest":{"queue":[{"id":"q"},{"id":""},{"id":5},"odd",{}]},"e":{}}'


def rows_of(spark, once=False):
    return N.flatten_json(spark.createDataFrame([(1, DOC), (2, "7"), (3, '[[],{"k":"z"}]'), (4, "[]")], "flow_id int, definition string"), once=once)


def test_members_are_those_of_the_rows_below(spark):
    rows = rows_of(spark).collect()
    for r in rows:
        below = {x.key: x for x in rows if r.type == "OBJECT" and x.flow_id == r.flow_id and x.parent == r.pointer and x.scalar is not None}
        assert r.fields.keys() == below.keys() and r.kinds.keys() == {k for k, x in below.items() if x.type != "STRING"}
    paths = rows_of(spark)
    got = N.fields_of(paths, paths.where("pointer = '/a'"), ["s", "i", "b", "n", "v", "o"]).collect()
    assert [tuple(r)[2:] for r in got] == [("x", "7", "true", "1.5", None, None)]
    assert "fields" not in pseudonymize(paths).columns


def test_extractors_of_members_read_the_rows_once_without_a_shuffle(spark, monkeypatch):
    """Each field list was a scan, an aggregation by sort and a join of its own."""
    written = []
    monkeypatch.setattr(N, "materialize", lambda df, name: written.append(name))
    for made in (N.extract_nodes, N.extract_variables, N.manifest_entries, E.manifest_deviations):
        plan = made(rows_of(spark, once=True))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    assert not written
    assert {r.pointer for r in E.manifest_deviations(rows_of(spark, once=True)).collect()} == {f"/manifest/queue/{i}" for i in (1, 2, 3, 4)}
