"""What leaves the walk for a reader that says what it reads, against the rows of all values."""

from flowlake.operators import edges as E
from flowlake.operators import normalize as N
from flowlake.plans.edge_queries import ID, MENU

ODD = '{"flowSequenceItemList":[{"id":"c","trackingId":7,"actionList":[{"id":"a","n":1.50,"x":null},5,[]]},"odd"],"variables":[{"id":"v","name":"n","isInput":true},7,{}],"manifest":{"queue":[{"id":"q","name":"Q"},"odd"],"~/":[{"id":"w"}]},"k":12345678901234567890}'


def docs(spark):
    menu = [MENU.replace("%1$s", ID[c]).replace("%2$d", str(i)) for i, c in enumerate("BDU")]
    menu.append(menu[0].replace('"config":{"x"', '"config":{"deep":{"y":[{"z":"' + ID["B"] + '"}]},"x"').replace('"plain"', '"Config\\n":{"config":[],"v":"' + ID["B"] + '"},"plain"'))
    return spark.createDataFrame([*enumerate([*menu, ODD, "7", "[]", "{broken"])], "flow_id int, definition string")


def rows(df):
    return sorted(map(str, df.collect()))


def test_kept_values_are_those_that_the_reader_filters(spark):
    every = N.flatten_json(docs(spark))
    for read, make in ((N.NODES, N.extract_nodes), (N.VARIABLES, N.extract_variables), (N.ENTRIES, N.extract_dependencies)):
        some = N.flatten_json(docs(spark), once=True, **read)
        assert set(some.columns) == {"flow_id", "pointer", "type", "scalar", "fields", "kinds"} and some.count() < every.count() / 2
        assert rows(make(some)) == rows(make(every))
    only = N.flatten_json(docs(spark), once=True, keep=N.at_pointers("^$"), columns=("pointer",))
    assert only.columns == ["flow_id", "pointer"] and sorted(r.flow_id for r in only.collect()) == list(range(7))
    typed = N.flatten_json(docs(spark), once=True, columns=("type",))
    assert rows(typed.select("flow_id", "type")) == rows(every.select("flow_id", "type"))


def test_edges_of_kept_rows_are_those_of_all(spark):
    every = N.flatten_json(docs(spark))
    kept = E.edge_rows(N.flatten_json(docs(spark), once=True, keep=E.kept_rows, columns=E.COLUMNS))
    assert kept.count() < every.count() / 2
    for part in (0, 1):
        have, want = (E.extract_edges(p, N.extract_nodes(p), N.extract_dependencies(p))[part] for p in (kept, every))
        assert rows(have) == rows(want) and have.count() > 3
    for made in (E.variable_writes, E.dependency_contexts):
        assert rows(made(kept, N.extract_nodes(kept))) == rows(made(every, N.extract_nodes(every)))


def test_owner_and_steps_are_found_once_a_row(spark):
    """The owner's pattern was matched again in every use, for each part of each pointer within a lambda."""
    plan = E._other_fields(N.flatten_json(docs(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(pointer") == 1 and plan.count("split(") == 1
