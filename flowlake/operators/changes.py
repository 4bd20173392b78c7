"""Differences between two versions of every flow, collection by collection, and the semantic changes that they amount to.

Tables come in pairs (before, after): flow(flow_id, metadata, version fields, graph_hash), node, edge, variable, dependency,
entry(flow_id, node_id) and warning(flow_id, code, severity, evidence_ids). Rows are matched by their ids, never by names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.operators.diff import compare, pair_slots
from flowlake.tables import materialize

# Compared fields of each collection, in order, and which of them are sets.
NODE_FIELDS = ["name", "container_path", "source_type", "support_level", "variable_reads", "variable_writes", "dependency_refs", "prompt_refs", "settings"]
NODE_SETS = ["variable_reads", "variable_writes", "dependency_refs", "prompt_refs"]
VARIABLE_FIELDS = ["name", "scope", "data_type", "direction", "secure", "read_node_ids", "write_node_ids"]
DEPENDENCY_FIELDS = ["type", "display_name", "status", "referenced_by"]
FLOW_FIELDS = ["name", "description", "type", "secure", "division_id", "division_name", "languages"]
VERSION_FIELDS = ["selected", "state", "published", "latest_checked_in"]
OUTCOME_ROLES = ["success", "failure", "timeout", "no-input", "no_input", "no-match", "no_match"]
STRUCTURAL_ROLES = ["entry", "next", "transfer-menu", "transfer-task", "menu-choice"]
SUPPORT_RANK = {"full": 3, "partial": 2, "opaque": 1, "unsupported": 0}
COVERAGE_CODE = "(?i)UNSUPPORTED|OPAQUE|COVERAGE"

Pair = tuple[DataFrame, DataFrame]
COLUMNS = ["flow_id", "category", "operation", "subject", "aspect", "field", "secure", "dependency_type", "direction"]


def coverage_warning(code):
    """Whether a warning's code names a gap of coverage."""
    return F.coalesce(F.rlike(code, F.lit(COVERAGE_CODE)), F.lit(False))


def node_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """flow_id, node_id, b, a, op, fields and basis: trackingId where both sides have one, else derivedIdentity; unmatched
    for a node of one side. settings is a map of canonical JSON texts, so the order of keys is no change and that of a list is."""
    plain = lambda df: df.withColumn("settings", F.array_sort(F.map_entries("settings")))
    rows = compare(plain(before), plain(after), ["flow_id", "node_id"], NODE_FIELDS, NODE_SETS)
    tracked = F.col("b.tracking_id").isNotNull() & F.col("a.tracking_id").isNotNull()
    basis = F.when(F.col("op").isin("added", "removed"), "unmatched").when(tracked, "trackingId").otherwise("derivedIdentity")
    return rows.withColumn("basis", basis)


def edge_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """flow_id, before_id, after_id, src, role, op and fields of every edge added, removed or changed. An edge keeps its id
    while only its label changes; a slot (source, role) that lost one edge and got one had it rerouted."""
    rows = compare(before, after, ["flow_id", "edge_id"], ["label"])
    alone = lambda op, side: rows.where(F.col("op") == op).select("flow_id", "edge_id", *(F.col(f"{side}.{c}").alias(c) for c in ("src", "role", "dst", "condition", "label")))
    gone, new = alone("removed", "b"), alone("added", "a")
    moved = pair_slots(gone, new, ["flow_id", "src", "role"])
    differs = [F.when(~F.col(f"removed.{c}").eqNullSafe(F.col(f"added.{c}")), F.lit(c)) for c in ("dst", "condition", "label")]
    none = F.array().cast("array<string>")
    nothing = F.lit(None).cast("string")
    moved = moved.select("flow_id", F.col("removed.edge_id").alias("before_id"), F.col("added.edge_id").alias("after_id"), "src", "role", F.lit("changed").alias("op"), F.array_compact(F.array(*differs)).alias("fields"))
    rest = lambda df, own: df.join(moved.select("flow_id", F.col(own).alias("edge_id")), ["flow_id", "edge_id"], "left_anti")
    relabeled = rows.where("op = 'changed'").select("flow_id", F.col("edge_id").alias("before_id"), F.col("edge_id").alias("after_id"), "a.src", "a.role", "op", "fields")
    removed = rest(gone, "before_id").select("flow_id", F.col("edge_id").alias("before_id"), nothing.alias("after_id"), "src", "role", F.lit("removed").alias("op"), none.alias("fields"))
    added = rest(new, "after_id").select("flow_id", nothing.alias("before_id"), F.col("edge_id").alias("after_id"), "src", "role", F.lit("added").alias("op"), none.alias("fields"))
    return relabeled.unionByName(moved).unionByName(removed).unionByName(added)


def variable_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """flow_id, variable_id, op, fields, and secure if either side is."""
    rows = compare(before, after, ["flow_id", "variable_id"], VARIABLE_FIELDS, ["read_node_ids", "write_node_ids"])
    return rows.withColumn("secure", F.coalesce("b.secure", F.lit(False)) | F.coalesce("a.secure", F.lit(False))).drop("b", "a")


def dependency_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """flow_id, dependency_id, op, fields, and the type (the later one)."""
    rows = compare(before, after, ["flow_id", "dependency_id"], DEPENDENCY_FIELDS, ["referenced_by"])
    return rows.withColumn("type", F.coalesce("a.type", "b.type")).drop("b", "a")


def _rows(df: DataFrame, **values) -> DataFrame:
    """The columns of a change: those given, others null."""
    given = {k: v if not isinstance(v, str) else F.lit(v) for k, v in values.items()}
    kind = lambda c: "boolean" if c == "secure" else "string"
    return df.select(*(given.get(c, F.col("flow_id") if c == "flow_id" else F.lit(None)).cast(kind(c) if c != "flow_id" else df.schema["flow_id"].dataType).alias(c) for c in COLUMNS))


def _has(name: str):
    return F.array_contains("fields", name)


def flow_rules(flow: Pair) -> list[DataFrame]:
    """Metadata, languages, and a version that changed while the graph did not."""
    plain = lambda df: df.withColumn("languages", F.coalesce("languages", F.array().cast("array<string>")))
    both = materialize(compare(plain(flow[0]), plain(flow[1]), ["flow_id"], FLOW_FIELDS, ["languages"]).where("b is not null and a is not null"), "flow_changes")
    each = both.select("flow_id", F.explode("fields").alias("f"))
    moved = reduce(lambda x, y: x | y, (~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")) for f in VERSION_FIELDS))
    return [
        _rows(each.where("f <> 'languages'"), category="flow-metadata-changed", operation="changed", subject=F.col("f"), field=F.col("f")),
        _rows(each.where("f = 'languages'"), category="prompt-reference-changed", operation="changed", subject="flow-languages"),
        _rows(both.where(moved & F.col("b.graph_hash").eqNullSafe(F.col("a.graph_hash"))), category="published-version-only-changed", operation="changed"),
    ]


def entry_rules(entry: Pair, nodes: DataFrame) -> list[DataFrame]:
    """Entries that only one side has; an entry whose node is not on both sides counts on each side that has it."""
    side = lambda df, name: df.select("flow_id", "node_id").distinct().withColumn(name, F.lit(True))
    kept = nodes.where("basis <> 'unmatched'").select("flow_id", "node_id", F.lit(True).alias("matched"))
    rows = side(entry[0], "was").join(side(entry[1], "is"), ["flow_id", "node_id"], "full_outer").join(kept, ["flow_id", "node_id"], "left")
    still = F.col("was").isNotNull() & F.col("is").isNotNull() & F.col("matched").isNotNull()
    return [_rows(rows.where(F.col(c).isNotNull() & ~still), category="entry-point-changed", operation=op, subject=F.col("node_id")) for c, op in (("is", "added"), ("was", "removed"))]


def node_rules(nodes: DataFrame) -> list[DataFrame]:
    """Presence; and for changed nodes their prompts, coverage, settings (an expression apart) and what else was configured."""
    own = F.col("node_id")
    changed = nodes.where("op = 'changed'")
    rank = F.create_map(*(F.lit(x) for p in SUPPORT_RANK.items() for x in p))
    was, now = F.element_at(rank, F.col("b.support_level")), F.element_at(rank, F.col("a.support_level"))
    pick = lambda side: F.filter(F.coalesce(side, F.array()), lambda e: e["key"] == "expression")
    expression = ~pick(F.col("b.settings")).eqNullSafe(pick(F.col("a.settings")))
    rest = F.array_except("fields", F.array(F.lit("support_level"), F.lit("settings")))
    cosmetic = F.size(F.array_except(rest, F.array(F.lit("name"), F.lit("container_path")))) == 0
    return [
        _rows(nodes.where("op in ('added', 'removed')"), category="action-changed", operation=F.col("op"), subject=own, aspect="presence"),
        _rows(changed.where(_has("prompt_refs")), category="prompt-reference-changed", operation="changed", subject=own),
        _rows(changed.where(_has("support_level") & (was != now)), category="coverage-changed", operation="changed", subject=own, direction=F.when(now < was, "regressed").otherwise("improved")),
        _rows(changed.where(_has("settings")), category=F.when(expression, "condition-expression-changed").otherwise("action-changed"), operation="changed", subject=own, aspect=F.when(~expression, "reconfigured")),
        _rows(changed.where(F.size(rest) > 0), category="action-changed", operation="changed", subject=own, aspect=F.when(cosmetic, "relabeled").otherwise("reconfigured")),
    ]


def edge_rules(edges: DataFrame) -> DataFrame:
    """A change of menu choice, outcome path, condition or action, by the role of the edge and what changed."""
    kept = F.col("op") == "changed"
    menu, outcome, structural = F.col("role") == "menu-choice", F.col("role").isin(OUTCOME_ROLES), F.col("role").isin(STRUCTURAL_ROLES)
    condition = kept & _has("condition") & ~structural
    category = F.when(menu, "menu-choice-changed").when(outcome, "outcome-path-changed").when(condition, "condition-expression-changed").otherwise("action-changed")
    routed = F.when(structural, "position").otherwise("reconfigured")
    aspect = F.when(menu, F.when(~kept, "presence").when(_has("dst"), "route").otherwise("label")).when(outcome, F.col("role"))
    aspect = aspect.when(condition, None).when(~kept | _has("dst"), routed).otherwise("relabeled")
    rows = edges.withColumn("role", F.coalesce("role", F.lit("")))
    return _rows(rows, category=category, operation=F.col("op"), subject=F.col("src"), aspect=aspect)


def semantic_changes(flow: Pair, node: Pair, edge: Pair, variable: Pair, dependency: Pair, entry: Pair, warning: Pair) -> DataFrame:
    """One row a change: flow_id, category, operation, subject, aspect, field, secure, dependency_type and direction, as
    ``diff.classify`` reads them."""
    nodes = materialize(node_changes(*node), "node_changes")
    variables, dependencies = (df.where("op <> 'same'") for df in (variable_changes(*variable), dependency_changes(*dependency)))
    kept = F.col("op") == "changed"
    usage = F.when(~kept, "presence").when(_has("data_type"), "type").otherwise("usage-location")
    reference = F.when(~kept, "presence").when(_has("status"), "resolution").when(_has("referenced_by"), "reference").otherwise("displayName")
    key = ["flow_id", "code", "severity", "evidence_ids"]
    plain = lambda df: df.select("flow_id", "code", "severity", F.array_sort("evidence_ids").alias("evidence_ids"))
    new = plain(warning[1]).join(plain(warning[0]).distinct(), key, "left_anti").where(coverage_warning(F.col("code")))
    parts = [
        *flow_rules(flow), *entry_rules(entry, nodes), *node_rules(nodes), edge_rules(edge_changes(*edge)),
        _rows(variables, category="variable-changed", operation=F.col("op"), subject=F.col("variable_id"), aspect=usage, secure=F.col("secure")),
        _rows(dependencies, category="dependency-changed", operation=F.col("op"), subject=F.col("dependency_id"), aspect=reference, dependency_type=F.col("type")),
        _rows(new, category="coverage-changed", operation="added", direction="regressed"),
    ]
    return reduce(DataFrame.unionByName, parts)


def absent_flows(previous: DataFrame, discovered: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """flow_id and reason of earlier flows that a run did not discover: out-of-scope (ids were asked for, not this one),
    inaccessible (known as forbidden) or retire-candidate. discovered(flow_id, status)."""
    seen = discovered.where("status not in ('forbidden', 'not-found')").select("flow_id")
    rows = previous.select("flow_id").distinct().join(seen, "flow_id", "left_anti").join(discovered.where("status = 'forbidden'").select("flow_id", F.lit(True).alias("forbidden")).distinct(), "flow_id", "left")
    asked = rows.withColumn("asked", F.lit(True)) if wanted is None else rows.join(wanted.select("flow_id").distinct().withColumn("asked", F.lit(True)), "flow_id", "left")
    return asked.select("flow_id", F.when(F.col("asked").isNull(), "out-of-scope").when(F.col("forbidden"), "inaccessible").otherwise("retire-candidate").alias("reason"))
