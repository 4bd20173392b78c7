"""Strong components: both ways against brute force, and the rows that colouring writes."""

import random

import pytest

from flowlake.operators import graph as G


def plain(edges):
    """Components of one flow by reachability of every node."""
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)

    def reach(a):
        seen, work = set(), [a]
        while work:
            for b in ahead.get(work.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    work.append(b)
        return seen

    far = {a: reach(a) for a in ahead}
    return {tuple(sorted(b for b in far[a] if a in far.get(b, ()))) for a in ahead if a in far[a]}


def frames(spark, flows):
    node = spark.createDataFrame([(f, n) for f, edges in flows.items() for n in {x for e in edges for x in e}], "flow_id long, node_id string")
    edge = spark.createDataFrame([(f, f"e{k}", a, b) for f, edges in flows.items() for k, (a, b) in enumerate(edges)], "flow_id long, edge_id string, src string, dst string")
    return node, edge


def small_flows():
    rng = random.Random(1)
    flows = {f: [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(rng.randrange(1, 22))] for f in range(25)}
    flows |= {100: [("a", "a")], 101: [("a", "b"), ("b", "c")], 102: [("a", "b"), ("b", "a"), ("b", "b"), ("a", "b")], 103: [(f"{i:02d}", f"{(i + 1) % 5:02d}") for i in range(5)]}
    return flows


@pytest.mark.parametrize("small", [G.SMALL_FLOW, 12])
def test_components(spark, small):
    flows = small_flows()
    got = {}
    for r in G.strongly_connected_components(*frames(spark, flows), small=small).collect():
        assert r.size == len(r.nodes) and r.component == r.nodes[0]
        got.setdefault(r.flow_id, set()).add(tuple(r.nodes))
    assert got == {f: c for f, e in flows.items() if (c := plain(e))}


def test_colouring_writes_few_rows(spark, monkeypatch):
    rng = random.Random(2)
    edges = {(f"n{a:04d}", f"n{b:04d}") for a, b in ((rng.randrange(5000), rng.randrange(5000)) for _ in range(9000)) if a != b}
    written = []
    write = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name: written.append(out := write(df, name)) or out)
    got = {tuple(r.nodes) for r in G.strongly_connected_components(*frames(spark, {1: sorted(edges)}), small=0).collect()}
    assert sum(x.count() for x in written) < 50 * len(edges)
    whole = {tuple(r.nodes) for r in G.strongly_connected_components(*frames(spark, {1: sorted(edges)})).collect()}
    assert got == whole and max(map(len, got)) > 1000


def test_no_edges(spark):
    node, edge = frames(spark, {1: [("a", "b")]})
    assert G.strongly_connected_components(node, edge.limit(0)).count() == 0
