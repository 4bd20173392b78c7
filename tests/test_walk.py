"""The walk of documents against a plain one, and what it makes a value."""

import pyarrow as pa

from flowlake.operators import normalize as N

TEXTS = ['{"a":{"b":[1,2]},"1":[{"0":true}]}', '{"a":[3,4],"1":{"0":1}}', "[[1],[1,2],[],{}]", '{"a":{"b":[1,2,{"c/~":null}]}}', " 3 4", '{"\\ud800":{"a":1.50}}']


def plain(at, parent, key, depth, value):
    yield at, parent, key, depth, N._KIND[type(value)]
    for k, x in value.items() if type(value) is dict else enumerate(value) if type(value) is list else ():
        yield from plain(f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}", at, str(k), depth + 1, x)


def test_walk_gives_each_value_once_at_its_place():
    import json

    read = json.JSONDecoder(parse_float=N._Number).raw_decode
    want = sorted((i, *(x.replace("\ud800", "?") if type(x) is str else x for x in row)) for i, t in enumerate(TEXTS) for row in plain("", "", "", 0, read(t.lstrip())[0]))
    batch = pa.record_batch([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["flow_id", "text"])
    rows = pa.Table.from_batches(N._walk_batches([batch])).to_pylist()
    assert sorted((r["flow_id"], r["pointer"], r["parent"] or "", r["key"] or "", r["depth"], r["type"]) for r in rows) == want


def test_documents_of_one_form_share_their_places():
    """Each value of each document made its own pointer, and the collector walked all documents of a batch again and again."""
    import gc

    places, made = N._Places(), {"a": [1, {"b": 2}], "c": None}
    for _ in range(100):
        places.walk(made)
    assert len(places.value) == 600 and len(places.pointer) == 6
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["1", "2"])], names=["flow_id", "text"])
    walk = N._walk_batches([batch])
    next(walk)
    assert not gc.isenabled()
    list(walk)
    assert gc.isenabled()
