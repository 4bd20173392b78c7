"""Readers of several kinds: what leaves the walk, and which containers it enters, against the rows of all values."""

import pytest
from test_kept import docs, rows

from flowlake.operators import normalize as N

REFS = '{"flowSequenceItemList":[{"__type":"Task","id":"c","startAction":"a","actionList":[{"id":"a","trackingId":1,"nextAction":"b","say":[{"config":{"ref":{"type":"pmt","val":"p"}}},{"config":{"ref":{"type":"pmt","val":"lost"}}},{"config":{"ref\\n":{"val":7}}}]},{"id":"b","startAction":["x"],"in":{"config":{"Add":{"operands":[{"config":{"ref":{"type":"int","val":"v"}}},{"config":{}}]}}}}],"menuChoiceList":[{"action":{"id":"m","nextAction":"gone","n":1.50}},{"action":7}]},5],"manifest":{"userPrompt":[{"id":"p","startAction":"q"}]},"startAction":"z","deep":{"ref":{"val":"w"}}}'
READERS = [
    (N.REFERENCES, lambda p: N.resolve(N.references(p), N.extract_nodes(p), N.extract_dependencies(p))),
    (N.READS, lambda p: N.variable_reads(p, N.extract_nodes(p))),
    (N.PROMPTS, lambda p: N.prompt_references(p, N.extract_nodes(p), N.extract_dependencies(p))[0]),
    (N.PROMPTS, lambda p: N.prompt_references(p, N.extract_nodes(p), N.extract_dependencies(p))[1]),
    (N.SETTINGS, lambda p: N.settings(p, N.extract_nodes(p), [*N.NOT_REFERENCES, "__type"])),
    (N.WRAPPERS, N.parse_value_refs),
    (N.NODES, lambda p: N.build_evidence(N.extract_nodes(p))),
]


@pytest.mark.parametrize("i", range(len(READERS)))
def test_kept_values_give_the_rows_of_all(spark, i):
    read, make = READERS[i]
    texts = docs(spark).unionByName(spark.createDataFrame([(10, REFS)], "flow_id int, definition string"))
    every, some = N.flatten_json(texts), N.flatten_json(texts, **read)
    assert rows(make(some)) == rows(make(every)) and make(every).where("flow_id = 10").count() > 0
    assert some.count() < every.count()


def test_walk_leaves_out_what_no_reader_wants():
    """All values of a document were recorded, and all containers entered, for whatever a reader kept."""
    import json

    document = json.loads(REFS)
    every, nodes, refs = N._Places(), N._Places(N.NODES["keep"]), N._Places(N.REFERENCES["keep"])
    for places in (every, nodes, refs):
        places.walk(document)
    assert every.seen == refs.seen == len(every.value) > 2 * nodes.seen and len(refs.value) < len(every.value)
    assert not any("/config" in p for p in (*nodes.pointer, *(at for at, _ in nodes.made)))
