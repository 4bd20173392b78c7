"""Edges of configuration documents from known fields, branch paths, menu choices and ids in other fields, with warnings; variable
writes; and what a document's manifest entries are used by. paths, nodes and dependencies come from ``normalize``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions.text import kebab_case
from flowlake.operators.normalize import CODE, GUID_LIKE, REFERENCE_ROLES, branch_role, field, fields_of, text_field
from flowlake.tables import materialize

# Fields that are never searched for further ids.
CLOSED = ["id", "referenceId", "actionList", "menuChoiceList", "variables", "startAction", "nextAction", "menuReference", "taskReference", "paths"]
OWNER = "^/flowSequenceItemList/[0-9]+(?:/actionList/[0-9]+|/menuChoiceList/[0-9]+/action)?"
_NODE, _PATH = OWNER + "$", OWNER + "/paths/[0-9]+$"  # extract_nodes takes no others, so no other object has an edge
# Objects that an extractor of this module or extract_nodes reads, value wrappers included.
_READ = "|".join([_NODE, _PATH, "^/flowSequenceItemList/[0-9]+/menuChoiceList/[0-9]+$", "/outputs/[0-9]+/value/config/ref$", "^/flowSequenceItemList/.*/config$", "^/manifest/"])
_CANDIDATE = ["flow_id", "owner", "site", "role", "label", "condition", "target", "path", "generic"]


COLUMNS = ("pointer", "parent", "key", "type", "scalar", "fields")  # what readers of edge_rows read


def _open_ids() -> Column:
    """Id-shaped strings in open fields, but for those that stand in arrays. Length and name cost less than the pattern."""
    near = (F.col("type") == "STRING") & F.length("scalar").between(36, 37) & ~F.col("key").isin(CLOSED)
    return near & F.rlike("scalar", F.lit(GUID_LIKE)) & ~F.rlike("key", F.lit("^[0-9]+$"))


def kept_rows(places, at, kind):
    """``keep`` of ``flatten_json`` for readers of ``edge_rows``: the objects that they read, and ids in open fields."""
    import re

    import numpy as np

    read, number = re.compile(_READ, re.DOTALL).search, re.compile("^[0-9]+$").search
    objects = np.fromiter((read(p) is not None for p in places.pointer), bool, len(places.pointer))[at]
    open_field = np.fromiter((k is not None and k not in CLOSED and not number(k) for k in places.key), bool, len(places.key))[at]
    out = objects & (kind == CODE[dict])
    near = np.flatnonzero(open_field & (kind == CODE[str]))
    out[near] = [36 <= len(places.value[i]) <= 37 for i in near.tolist()]
    return out


_PARTS = {"node": _NODE, "path": _PATH, "choice": "^/flowSequenceItemList/[0-9]+/menuChoiceList/[0-9]+$", "entry": "^/manifest/"}


def edge_rows(paths: DataFrame) -> DataFrame:
    """The rows of paths that this module and ``extract_nodes`` read: objects with their members, and ids that may refer to a node. They
    are written by ``part``, so that an extractor reads only the files of its kind; paths may be rows that are read only once."""
    rows = paths.where((F.col("type") == "OBJECT") | _open_ids())
    part = F.when(F.col("type") == "STRING", "id")
    for name, pattern in _PARTS.items():
        part = part.when(F.rlike("pointer", F.lit(pattern)), name)
    part = part.when(F.rlike("pointer", F.lit("^/flowSequenceItemList/(?s:.*)/config$")), "config").otherwise("other")
    return materialize(rows.withColumn("part", part), "edge_rows", by="part")


def _part(paths: DataFrame, *parts: str) -> DataFrame:
    """The rows of some parts, of paths that have them."""
    return paths.where(F.col("part").isin(*parts)) if "part" in paths.columns else paths


def _known_fields(paths: DataFrame) -> DataFrame:
    role = F.create_map(*(F.lit(x) for p in REFERENCE_ROLES.items() for x in p))
    refs = F.array_compact(F.array(*(F.when(text_field(k).isNotNull(), F.struct(F.lit(k).alias("key"), text_field(k).alias("target"))) for k in REFERENCE_ROLES)))
    any_of = reduce(Column.__or__, (text_field(k).isNotNull() for k in REFERENCE_ROLES))
    rows = _part(paths, "node").where("type = 'OBJECT'").where(F.rlike("pointer", F.lit(_NODE))).where(any_of).select("flow_id", "pointer", field("menuName").alias("menuName"), field("taskName").alias("taskName"), F.explode(refs).alias("ref"))
    rows = rows.select("flow_id", "pointer", "menuName", "taskName", "ref.key", "ref.target", F.concat_ws("/", "pointer", "ref.key").alias("path"))
    label = F.when(F.col("key") == "menuReference", F.col("menuName")).when(F.col("key") == "taskReference", F.col("taskName"))
    return rows.select("flow_id", F.col("pointer").alias("owner"), F.col("key").alias("site"), F.element_at(role, F.col("key")).alias("role"), label.alias("label"), F.lit(None).cast("string").alias("condition"), "target", "path", F.lit(False).alias("generic"))


def _branches(paths: DataFrame) -> DataFrame:
    objects = _part(paths, "path").where("type = 'OBJECT'").where(F.rlike("pointer", F.lit(_PATH)))
    rows = fields_of(paths, objects, ["outputId", "label", "isDynamicBranch", "nextActionId"]).where("nextActionId is not null")
    output = F.nullif("outputId", F.lit(""))
    return rows.select(
        "flow_id", F.regexp_replace("pointer", "/paths/[0-9]+$", "").alias("owner"), F.concat(F.lit("path:"), F.coalesce(output, F.lit("unlabeled"))).alias("site"),
        branch_role(F.col("outputId"), F.col("isDynamicBranch") == "true").alias("role"), "label", output.alias("condition"), F.col("nextActionId").alias("target"), F.concat("pointer", F.lit("/nextActionId")).alias("path"), F.lit(False).alias("generic"),
    )


def _other_fields(paths: DataFrame) -> DataFrame:
    """Id-shaped strings anywhere below a node, but for closed fields, strings that stand in arrays, and value wrappers."""
    rows = _part(paths, "id").where(_open_ids())
    once = lambda value, name: F.explode(F.array(value)).alias(name)  # noqa: E731  # else each later use matches and splits anew, also within lambdas
    rows = rows.select("flow_id", "pointer", "key", "scalar", once(F.regexp_extract("pointer", OWNER, 0), "owner")).where("owner <> ''")
    rows = rows.select("flow_id", "key", "scalar", "owner", once(F.split(F.expr("substr(pointer, length(owner) + 2)"), "/"), "steps"))
    rows = rows.where(~F.arrays_overlap("steps", F.array(*map(F.lit, CLOSED))))
    rows = rows.withColumn("inside", F.expr("transform(sequence(0, size(steps) - 1), n -> concat_ws('/', owner, slice(steps, 1, n)))"))
    wrappers = _part(paths, "config").where("key = 'config' and type = 'OBJECT'").groupBy("flow_id").agg(F.collect_set("parent").alias("wrappers"))  # no more than the document has
    rows = rows.join(wrappers, "flow_id", "left").where(~F.coalesce(F.arrays_overlap("wrappers", "inside"), F.lit(False)))
    rows = rows.select("flow_id", "key", "scalar", "owner", once(F.regexp_replace(F.array_join("steps", "/"), "/([0-9]+)(?=/|$)", "[$1]"), "field"))
    field = F.col("field")
    return rows.select("flow_id", "owner", F.concat(F.lit("field:"), field).alias("site"), kebab_case(F.col("key")).alias("role"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("condition"),
                       F.col("scalar").alias("target"), F.concat("owner", F.lit("/"), field).alias("path"), F.lit(True).alias("generic"))


def _menu_choices(paths: DataFrame) -> DataFrame:
    choice = _part(paths, "choice").where("type = 'OBJECT'").where(F.rlike("pointer", F.lit("^/flowSequenceItemList/[0-9]+/menuChoiceList/[0-9]+$")))
    own = fields_of(paths, choice, ["digit", "name", "id"])
    action = _part(paths, "node").where("type = 'OBJECT'").where(F.rlike("pointer", F.lit("^/flowSequenceItemList/[0-9]+/menuChoiceList/[0-9]+/action$"))).select("flow_id", F.regexp_replace("pointer", "/action$", "").alias("pointer"), text_field("id").alias("target")).where("target is not null")
    name = F.nullif("name", F.lit(""))
    digit = F.when(F.expr("try_cast(digit AS DOUBLE)").isNotNull(), F.col("digit"))
    label = F.coalesce(F.concat(digit, F.lit(": "), name), name, digit)
    site = F.concat(F.lit("choice:"), F.coalesce(F.nullif("id", F.lit("")), F.lit("unindexed")))
    return own.join(action, ["flow_id", "pointer"]).select("flow_id", F.regexp_replace("pointer", "/menuChoiceList/[0-9]+$", "").alias("owner"), site.alias("site"), F.lit("menu-choice").alias("role"), label.alias("label"), "target")


def extract_edges(paths: DataFrame, nodes: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges: flow_id, edge_id, src, dst, role, label, condition; warnings: flow_id, code, severity, path, node_ids). A target is a node
    of the document, else a dependency (no edge), else dangling. Of two nodes with one source id the last counts."""
    known = materialize(nodes.where("source_id is not null").select("flow_id", "pointer", "node_id", "source_id"), "nodes")  # three joins read them
    src = known.select("flow_id", F.col("pointer").alias("owner"), F.col("node_id").alias("src"))
    dst = known.groupBy("flow_id", F.col("source_id").alias("target")).agg(F.max_by("node_id", "pointer").alias("dst"))
    held = dependencies.select("flow_id", F.col("dependency_id").alias("target"), F.lit(True).alias("held")).distinct()
    found = reduce(DataFrame.unionByName, (p.select(*_CANDIDATE) for p in (_known_fields(paths), _branches(paths), _other_fields(paths)))).where("target <> ''")
    rows = materialize(found.join(src, ["flow_id", "owner"]).join(dst, ["flow_id", "target"], "left").join(held, ["flow_id", "target"], "left"), "references")
    menu = _menu_choices(paths).join(src, ["flow_id", "owner"]).join(dst, ["flow_id", "target"]).withColumn("condition", F.lit(None).cast("string"))
    columns = ["flow_id", "src", "dst", "role", "label", "condition", "site"]
    edges = rows.where("dst is not null").select(*columns).unionByName(menu.select(*columns))
    edge_id = F.concat("src", F.lit("->"), "dst", F.lit("#"), "role", F.lit("@"), "site")
    lost = rows.where("dst is null and held is null").select("flow_id", F.lit("DANGLING_REFERENCE").alias("code"), F.lit("warning").alias("severity"), "path", F.array("src").alias("node_ids"))
    odd = rows.where("dst is not null and generic").select("flow_id", F.lit("UNRECOGNISED_REFERENCE_FIELD").alias("code"), F.lit("info").alias("severity"), "path", F.array("src", "dst").alias("node_ids"))
    return edges.select("flow_id", edge_id.alias("edge_id"), *columns[1:-1]), lost.unionByName(odd)


def variable_writes(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """flow_id, variable_id and node_id of variables that a node's outputs store to."""
    refs = _part(paths, "other").where("type = 'OBJECT'").where(F.rlike("pointer", F.lit(OWNER + "/outputs/[0-9]+/value/config/ref$"))).withColumn("variable_id", field("val")).where("variable_id is not null")
    own = nodes.select("flow_id", F.col("pointer").alias("owner"), "node_id")
    return refs.select("flow_id", "variable_id", F.regexp_replace("pointer", "/outputs/[0-9]+/value/config/ref$", "").alias("owner")).join(own, ["flow_id", "owner"]).select("flow_id", "variable_id", "node_id").distinct()


def dependency_contexts(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """flow_id, type, dependency_id, referenced_by (nodes) and other_contexts of every manifest entry with an id."""
    named = _part(paths, "entry").where("type = 'OBJECT'").where(F.startswith("pointer", F.lit("/manifest/"))).withColumn("id", text_field("id")).where("id <> ''")
    entry = named.where(F.rlike("pointer", F.lit("^/manifest/[^/]+/[0-9]+$"))).select("flow_id", F.col("pointer").alias("entry"), F.col("id").alias("dependency_id"))
    used = named.where(F.rlike("pointer", F.lit("^/manifest/[^/]+/[0-9]+/context/[0-9]+$"))).select("flow_id", F.regexp_replace("pointer", "/context/[0-9]+$", "").alias("entry"), F.col("id").alias("target"))
    dst = nodes.where("source_id is not null").groupBy("flow_id", F.col("source_id").alias("target")).agg(F.max_by("node_id", "pointer").alias("dst"))
    rows = entry.join(used, ["flow_id", "entry"], "left").join(dst, ["flow_id", "target"], "left")
    other = F.when(F.col("dst").isNull(), F.col("target"))
    out = rows.groupBy("flow_id", "entry", "dependency_id").agg(F.array_sort(F.collect_list("dst")).alias("referenced_by"), F.array_sort(F.collect_list(other)).alias("other_contexts"))
    return out.select("flow_id", F.regexp_extract("entry", "^/manifest/([^/]+)/", 1).alias("type"), "dependency_id", "referenced_by", "other_contexts")


def manifest_deviations(paths: DataFrame) -> DataFrame:
    """flow_id and pointer of manifest entries that are no objects or have no usable id."""
    spots = paths.where(F.rlike("pointer", F.lit("^/manifest/[^/]+/[0-9]+$")))
    return spots.where((F.col("type") != "OBJECT") | ~F.coalesce(text_field("id") != "", F.lit(False))).select("flow_id", "pointer")
