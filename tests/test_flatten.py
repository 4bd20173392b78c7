"""The walk of documents, and queries over documents at the size of their input."""

from flowlake.operators import normalize as N

ODD = '{"a":1.50,"b":1e5,"c":-0,"d":12345678901234567890,"e":true,"f":null,"g":{},"h":[[],"x"],"~/":{"/~":[-9223372036854775809]},"s":"\\ud800"}'


def test_one_write_a_corpus_whatever_its_depth(spark, monkeypatch):
    """A table was written for each level of the deepest document, with the sub-trees below."""
    written, once = [], N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, name: written.append(name) or once(df, name))
    deep = "[" * 60 + "7" + "]" * 60
    docs = spark.createDataFrame([(1, deep), (2, ODD), (3, '{"a":1,"a":2}'), (4, "{broken"), (5, None), (6, " 3 4")], "flow_id int, definition string")
    rows = N.flatten_json(docs).collect()
    assert written == ["json_path"]
    assert [(r.pointer, r.type, r.scalar) for r in rows if r.flow_id == 1 and r.depth == 60] == [("/0" * 60, "BIGINT", "7")]
    got = {r.pointer: (r.parent, r.key, r.depth, r.type, r.scalar) for r in rows if r.flow_id == 2}
    assert got[""] == (None, None, 0, "OBJECT", None) and len(got) == 15
    assert [got[f"/{k}"][3:] for k in "abcdefg"] == [("DECIMAL", "1.5"), ("DOUBLE", "100000.0"), ("BIGINT", "0"), ("DECIMAL", "12345678901234567890"), ("BOOLEAN", "true"), ("VOID", None), ("OBJECT", None)]
    assert got["/h/1"] == ("/h", "1", 2, "STRING", "x") and got["/~0~1/~1~0/0"] == ("/~0~1/~1~0", "0", 3, "DECIMAL", "-9223372036854775809")
    assert got["/s"][4] == "?"
    assert {r.flow_id for r in rows} == {1, 2, 6} and [r.scalar for r in rows if r.flow_id == 6] == ["3"]
