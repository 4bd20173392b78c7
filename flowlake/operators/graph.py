"""Control-graph operators over all flows at once: node(flow_id, node_id), edge(flow_id, edge_id, src, dst), entry(flow_id, node_id)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.tables import materialize

MAX_ROUNDS = 10_000


def node_as(node: DataFrame, name: str) -> DataFrame:
    return node.select("flow_id", F.col("node_id").alias(name))


def valid_edges(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Edges with both ends present."""
    return edge.join(node_as(node, "dst"), ["flow_id", "dst"], "left_semi").join(node_as(node, "src"), ["flow_id", "src"], "left_semi")


def reachability(node: DataFrame, edge: DataFrame, entry: DataFrame) -> DataFrame:
    """flow_id, node_id, depth: nodes reachable from the entries that exist, by a semi-naive frontier; a round a level."""
    steps = materialize(valid_edges(node, edge).select("flow_id", "src", "dst").distinct(), "steps")
    seen = materialize(entry.join(node, ["flow_id", "node_id"], "left_semi").select("flow_id", "node_id").distinct().withColumn("depth", F.lit(0)), "reach")
    frontier = seen
    for depth in range(1, MAX_ROUNDS):
        ahead = frontier.select("flow_id", F.col("node_id").alias("src")).join(steps, ["flow_id", "src"]).select("flow_id", F.col("dst").alias("node_id")).distinct()
        frontier = materialize(ahead.join(seen, ["flow_id", "node_id"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError("reachability did not settle")


def unreachable_nodes(node: DataFrame, reached: DataFrame) -> DataFrame:
    return node.join(reached, ["flow_id", "node_id"], "left_anti")


def dangling_edges(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Edges whose target is missing, whether or not the source is there."""
    return edge.join(node_as(node, "dst"), ["flow_id", "dst"], "left_anti")


def terminal_nodes(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Nodes without an outgoing edge to an existing target."""
    out = edge.join(node_as(node, "dst"), ["flow_id", "dst"], "left_semi").select("flow_id", F.col("src").alias("node_id"))
    return node.join(out, ["flow_id", "node_id"], "left_anti")


SMALL_FLOW = 50_000  # edges of a flow that one task takes whole


def strongly_connected_components(node: DataFrame, edge: DataFrame, small: int = SMALL_FLOW) -> DataFrame:
    """flow_id, component (its smallest node), size and sorted nodes, of two nodes or more or with a self-loop.

    A flow of at most ``small`` edges is one group, searched depth-first in time linear in its edges; larger ones are
    coloured together by joins (see ``coloured_components``), so no group grows without bound."""
    steps = materialize(valid_edges(node, edge).select("flow_id", "src", "dst").distinct(), "steps")
    large = materialize(steps.groupBy("flow_id").agg(F.count("*").alias("n")).where(F.col("n") > small).select("flow_id"), "large")
    kinds = {c: steps.schema[c].dataType.simpleString() for c in ("flow_id", "src")}
    members = steps.join(large, "flow_id", "left_anti").groupBy("flow_id").applyInArrow(_components_of_flow, f"flow_id {kinds['flow_id']}, node_id {kinds['src']}, component {kinds['src']}")
    if not large.isEmpty():
        members = members.unionByName(coloured_components(steps.join(large, "flow_id", "left_semi")))
    return members.groupBy("flow_id", "component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node_id")).alias("nodes"))


def _components_of_flow(rows: pa.Table) -> pa.Table:
    """Members of the components of one flow; nodes are visited from an explicit stack."""
    ahead: dict = {}
    for a, b in zip(rows["src"].to_pylist(), rows["dst"].to_pylist()):
        ahead.setdefault(a, []).append(b)
    number: dict = {}
    low, open_nodes, on_path, found = {}, [], set(), []
    for start in ahead:
        if start in number:
            continue
        work = [(start, iter(ahead[start]))]
        number[start] = low[start] = len(number)
        open_nodes.append(start)
        on_path.add(start)
        while work:
            at, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    open_nodes.append(to)
                    on_path.add(to)
                    work.append((to, iter(ahead.get(to, ()))))
                    break
                if to in on_path:
                    low[at] = min(low[at], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == number[at]:
                    own = [open_nodes.pop()]
                    while own[-1] != at:
                        own.append(open_nodes.pop())
                    on_path.difference_update(own)
                    if len(own) > 1 or at in ahead.get(at, ()):
                        first = min(own)
                        found += [(n, first) for n in own]
    flow, kind = rows.schema.field("flow_id").type, rows.schema.field("src").type
    return pa.table([pa.array([rows["flow_id"][0].as_py()] * len(found), flow), pa.array([n for n, _ in found], kind), pa.array([c for _, c in found], kind)], names=["flow_id", "node_id", "component"])


def coloured_components(steps: DataFrame) -> DataFrame:
    """flow_id, node_id, component over distinct edges (flow_id, src, dst), by rounds of trimming and colouring.

    A round drops edges whose start has no edge in or whose end has no edge out; gives every node the smallest node that reaches it as
    its colour; and walks back from each node that kept its own colour, within the colour: what it meets is its component. Edges
    between colours and of found nodes go, and the rest is coloured anew. Every step writes only what is new in it, so rows stay
    within a small multiple of the edges."""
    loops = steps.where("src = dst").select("flow_id", F.col("src").alias("node_id"), F.col("src").alias("component"))
    rest, out = steps.where("src <> dst"), None
    for _ in range(MAX_ROUNDS):
        ends, starts = rest.select("flow_id", F.col("dst").alias("src")).distinct(), rest.select("flow_id", F.col("src").alias("dst")).distinct()
        rest = materialize(rest.join(ends, ["flow_id", "src"], "left_semi").join(starts, ["flow_id", "dst"], "left_semi"), "steps")
        if rest.isEmpty():
            break
        colour = materialize(_colours(rest), "colour")
        inside = rest.join(colour.select("flow_id", F.col("node_id").alias("src"), "colour"), ["flow_id", "src"]).join(colour.select("flow_id", F.col("node_id").alias("dst"), "colour"), ["flow_id", "dst", "colour"])
        inside = materialize(inside, "inside")
        ahead = inside.where("dst = colour").select("flow_id", F.col("src").alias("node_id"), "colour").distinct()
        met = frontier = materialize(ahead.unionByName(ahead.select("flow_id", F.col("colour").alias("node_id"), "colour")).distinct(), "members")
        while True:
            back = inside.join(frontier.select("flow_id", F.col("node_id").alias("dst")), ["flow_id", "dst"]).select("flow_id", F.col("src").alias("node_id"), "colour").distinct()
            frontier = materialize(back.join(met, ["flow_id", "node_id"], "left_anti"), "members")
            if frontier.isEmpty():
                break
            met = met.unionByName(frontier)
        out = met if out is None else out.unionByName(met)
        gone = met.select("flow_id", F.col("node_id").alias("src"))
        rest = inside.select("flow_id", "src", "dst").join(gone, ["flow_id", "src"], "left_anti").join(gone.withColumnRenamed("src", "dst"), ["flow_id", "dst"], "left_anti")
    if out is None:
        return loops
    found = out.withColumnRenamed("colour", "component")
    return found.unionByName(loops.join(found, ["flow_id", "node_id"], "left_anti"))


def _colours(steps: DataFrame) -> DataFrame:
    """flow_id, node_id and colour: the smallest node that reaches it, itself included; a round tells the neighbours only of what changed."""
    nodes = steps.select("flow_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    all_of = changed = nodes.withColumn("colour", F.col("node_id"))
    for k in range(MAX_ROUNDS):
        told = steps.join(changed.select("flow_id", F.col("node_id").alias("src"), "colour"), ["flow_id", "src"]).groupBy("flow_id", F.col("dst").alias("node_id")).agg(F.min("colour").alias("colour"))
        was = all_of.select("flow_id", "node_id", F.col("colour").alias("was"))
        changed = materialize(told.join(was, ["flow_id", "node_id"]).where("colour < was").drop("was"), "changed")
        if changed.isEmpty():
            return all_of
        all_of = all_of.unionByName(changed).groupBy("flow_id", "node_id").agg(F.min("colour").alias("colour"))
        if k % 4 == 3:  # else the plan grows with the rounds
            all_of = materialize(all_of, "colours")
    raise RuntimeError("colours did not settle")


def nodes_in_cycles(components: DataFrame) -> DataFrame:
    return components.select("flow_id", F.explode("nodes").alias("node_id")).distinct()


def menu_offers(edge: DataFrame) -> DataFrame:
    """Sorted non-empty labels of each node's menu choices."""
    some = edge.where((F.col("role") == "menu-choice") & (F.length("label") > 0))
    return some.groupBy("flow_id", F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list("label")).alias("offers"))


# Node types that lead to another part of the same flow.
INSIDE = ["TransferMenuAction", "TransferTaskAction", "CallTaskAction", "TaskAction", "MenuAction", "PreviousMenuAction"]


def exit_kind(source_type: str = "source_type"):
    """disconnect, transfer (any type of that name that doesn't stay inside the flow) or other, by the type of a node."""
    kind = F.col(source_type)
    return F.when(kind == "DisconnectAction", "disconnect").when(kind.contains("Transfer") & ~kind.isin(INSIDE), "transfer").otherwise("other")


def journeys(node: DataFrame, edge: DataFrame, entry: DataFrame, max_depth: int = 60, max_journeys: int | None = 50) -> DataFrame:
    """flow_id, kind (transfer, disconnect, truncated, dead-end, loop) and steps of the simple paths from each entry.

    The cap takes journeys in the order of a depth-first stack, so a flow's graph is walked in one task; flows are
    bounded documents of some hundred nodes. Without a cap, level joins list all paths of up to max_depth nodes.
    """
    if max_journeys is None:
        return _all_journeys(node, edge, entry, max_depth)
    graph = node.select("flow_id", F.lit("node").alias("part"), F.col("node_id").alias("a"), exit_kind().alias("b"), F.lit("").alias("c"))
    graph = graph.unionByName(valid_edges(node, edge).select("flow_id", F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("edge_id").alias("c")))
    graph = graph.unionByName(entry.select("flow_id", F.lit("entry").alias("part"), F.col("node_id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c")))

    def walk(rows: pa.Table) -> pa.Table:
        kinds: dict[str, str] = {}
        edges, starts, ahead = [], set(), {}
        for part, x, y, z in zip(*(rows[c].to_pylist() for c in ("part", "a", "b", "c"))):
            if part == "node":
                kinds[x] = y
            elif part == "edge":
                edges.append((z, x, y))
            else:
                starts.add(x)
        for _, x, y in sorted(edges):
            ahead.setdefault(x, []).append(y)
        found: list[tuple[str, list[str]]] = []
        for start in sorted(starts & kinds.keys()):
            stack = [[start]]
            while stack and len(found) < max_journeys:
                path = stack.pop()
                kind, steps = kinds[path[-1]], ahead.get(path[-1], [])
                if kind in ("transfer", "disconnect"):
                    found.append((kind, path))
                elif len(path) >= max_depth:
                    found.append(("truncated", path))
                elif not steps:
                    found.append(("dead-end", path))
                else:
                    for to in steps:
                        if to not in path:
                            stack.append([*path, to])
                        elif len(found) < max_journeys:
                            found.append(("loop", [*path, to]))
        flow = rows.schema.field("flow_id").type
        columns = [pa.array([rows["flow_id"][0].as_py()] * len(found), flow), pa.array([k for k, _ in found], pa.string()), pa.array([p for _, p in found], pa.list_(pa.string()))]
        return pa.table(columns, names=["flow_id", "kind", "steps"])

    flow_type = node.schema["flow_id"].dataType.simpleString()
    return graph.groupBy("flow_id").applyInArrow(walk, f"flow_id {flow_type}, kind string, steps array<string>")


def _all_journeys(node: DataFrame, edge: DataFrame, entry: DataFrame, max_depth: int) -> DataFrame:
    kinds = node.select("flow_id", F.col("node_id").alias("at"), exit_kind().alias("exit"))
    steps = materialize(valid_edges(node, edge).select("flow_id", F.col("src").alias("at"), "dst"), "steps")
    leaves = steps.select("flow_id", "at").distinct().withColumn("more", F.lit(True))
    start = entry.join(node, ["flow_id", "node_id"], "left_semi").select("flow_id", F.col("node_id").alias("at"), F.array("node_id").alias("steps"))
    level, out = start, None
    for depth in range(1, max_depth + 1):
        level = materialize(level.join(kinds, ["flow_id", "at"]).join(leaves, ["flow_id", "at"], "left"), "paths")
        if level.isEmpty():
            break
        end = F.when(F.col("exit") != "other", F.col("exit")).when(F.lit(depth >= max_depth), "truncated").when(F.col("more").isNull(), "dead-end")
        ended = level.select("flow_id", end.alias("kind"), "steps").where("kind is not null")
        ahead = level.where(end.isNull()).select("flow_id", "at", "steps").join(steps, ["flow_id", "at"])
        again = F.array_contains("steps", F.col("dst"))
        loops = ahead.where(again).select("flow_id", F.lit("loop").alias("kind"), F.array_append("steps", F.col("dst")).alias("steps"))
        level = ahead.where(~again).select("flow_id", F.col("dst").alias("at"), F.array_append("steps", F.col("dst")).alias("steps"))
        done = ended.unionByName(loops)
        out = done if out is None else out.unionByName(done)
    return out if out is not None else start.select("flow_id", F.lit("").alias("kind"), "steps").limit(0)
