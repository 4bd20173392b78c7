"""Configuration documents to relations: one walk of the JSON, then joins and filters on its paths."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.tables import materialize

# Node types with modelled semantics.
KNOWN_TYPES = ["Task", "Menu", "MenuAction", "PlayAudioAction", "TransferMenuAction", "TransferTaskAction", "TransferPureMatchAction", "DecisionAction", "DisconnectAction", "DataAction"]


class _Number(str):
    """A number that is no 64-bit integer, as written."""


def _integer(text: str):
    x = int(text)
    return x if -(1 << 63) <= x < 1 << 63 else _Number(text)


_KIND = {dict: "OBJECT", list: "ARRAY", str: "STRING", int: "BIGINT", bool: "BOOLEAN", type(None): "VOID", _Number: "NUMBER"}
CODE = dict(zip(_KIND, range(len(_KIND))))
_TEXT = {int: str, bool: lambda x: "true" if x else "false", _Number: str}  # other types have none
_BATCH = 1 << 16  # values walked for a batch that leaves the walk
_TYPES = {"pointer": "string", "parent": "string", "key": "string", "depth": "int", "type": "string", "scalar": "string", "fields": "map<string,string>", "kinds": "map<string,string>"}
COLUMNS = ("flow_id", *_TYPES)


class _Places:
    """The places of a batch's values, those of a run of values in one container being made once for all containers of its pointer
    and names: pointer, parent, key and depth by number; for each run its first number, its size and the number of its container's value
    (-1: left out); and the values. With ``some`` (of ``at_pointers``) only runs that hold a wanted place, or lie right below one, are
    recorded, and only containers that may hold one are entered."""

    def __init__(self, some=None):
        self.pointer, self.parent, self.key, self.depth, self.made, self.some = [""], [None], [None], [0], {}, some
        self.first, self.size, self.owner, self.value, self.seen = [], [], [], [], 0

    def run(self, at: str, depth: int, names) -> tuple[int, list[str], bool, list[tuple[int, str]] | None]:
        """Number of the first place, and pointers, below a container; whether the run is recorded, and which of its containers are
        entered, if not all: names are its keys, or how many values it lists."""
        keys = list(map(str, range(names))) if type(names) is int else names
        steps = [k.replace("~", "~0").replace("/", "~1") for k in keys] if "~" in (joined := "".join(keys)) or "/" in joined else keys
        at_ = at + "/"
        below, some = [at_ + k for k in steps], self.some
        hit = some is None or some.wants(at) or any(map(some.wants, below))
        enter = None if some is None or some.within is None else [(i, p) for i, p in enumerate(below) if some.enters(p)]
        out = self.made[at, names] = len(self.pointer), below, hit, enter
        if hit:
            self.pointer += below
            self.parent += [at] * len(keys)
            self.key += keys
            self.depth += [depth] * len(keys)
        return out

    def walk(self, document) -> None:
        first, size, owner, value, made = self.first, self.size, self.owner, self.value, self.made
        todo, seen = [("", 1, document, len(value))], 1
        first.append(0), size.append(1), owner.append(-1), value.append(document)
        for at, depth, inner, number in todo:  # grows
            if type(inner) is dict:
                names, values = tuple(inner), inner.values()
            elif type(inner) is list:
                names, values = len(inner), inner
            else:
                continue
            if not names:
                continue
            start, below, hit, enter = made.get((at, names)) or self.run(at, depth, names)
            seen += len(below)
            at_value = len(value) if hit else None
            if hit:
                first.append(start), size.append(len(below)), owner.append(number)
                value += values
            if enter is None:
                if hit:
                    todo += [(p, depth + 1, x, i) for i, p, x in zip(range(at_value, len(value)), below, values) if type(x) is dict or type(x) is list]
                else:
                    todo += [(p, depth + 1, x, -1) for p, x in zip(below, values) if type(x) is dict or type(x) is list]
            elif enter:
                inside = list(values)
                todo += [(p, depth + 1, x, at_value + i if hit else -1) for i, p in enter if type(x := inside[i]) is dict or type(x) is list]
        self.seen += seen

    def members(self, kind, size, wanted):
        """Numbers of the scalar members of the wanted objects, in order, and for each value the number of those in it."""
        import numpy as np

        of_run, owner = np.repeat(np.arange(len(size)), size), np.array(self.owner)
        in_object = (owner >= 0) & (kind[owner] == CODE[dict]) & wanted[owner]  # runs stand in the order of their containers
        own = in_object[of_run] & (kind > CODE[list]) & (kind != CODE[type(None)])
        count = np.zeros(len(kind), np.int64)
        count[owner[in_object]] = np.bincount(of_run[own], minlength=len(size))[in_object]
        return np.flatnonzero(own), count


def _walk_batches(batches, columns=COLUMNS, keep=None):
    import gc

    gc.disable()  # documents are trees: nothing in them waits for the collector, which took half of the walk
    try:
        yield from _walked(batches, columns, keep)
    finally:
        gc.enable()


def _walked(batches, columns, keep):
    import json

    import numpy as np
    import pyarrow as pa

    def strings(values):
        try:
            return pa.array(values, pa.string())
        except UnicodeEncodeError:  # a lone surrogate is '?', as in Spark's own strings
            return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())

    kinds = strings(list(_KIND.values()))
    read = json.JSONDecoder(parse_float=_Number, parse_int=_integer).raw_decode  # Spark reads the first value of a text
    for batch in batches:
        flow, texts = batch.columns
        first = 0  # document of the batch
        some = keep if isinstance(keep, _AtPointers) else None
        ends, places = [0], _Places(some)

        def flush(last):
            size, types = np.array(places.size), list(map(type, places.value))
            at = np.repeat(np.array(places.first) - np.cumsum(size) + size, size) + np.arange(len(types))
            kind = np.fromiter(map(CODE.__getitem__, types), np.int8, len(types))
            wanted = np.ones(len(types), bool) if keep is None else keep(places, at, kind)
            some = np.flatnonzero(wanted)
            text_of = lambda own: strings([x if (t := types[i]) is str else _TEXT[t](x) if t in _TEXT else None for i, x in zip(own.tolist(), map(places.value.__getitem__, own.tolist()))])
            make = {
                "flow_id": lambda: flow.slice(first, last - first).take(pa.array(np.repeat(np.arange(last - first), np.diff(ends))[some])),
                **{c: lambda x=getattr(places, c): strings(x).take(pa.array(at[some])) for c in ("pointer", "parent", "key")},
                "depth": lambda: pa.array(np.array(places.depth, np.int32)[at[some]]), "type": lambda: kinds.take(pa.array(kind[some])), "scalar": lambda: text_of(some),
            }
            out = [make[c]() for c in columns if c in make]
            if "fields" in columns:
                own, count = places.members(kind, size, wanted)
                ends_of = np.concatenate([[0], np.cumsum(count)])
                odd = kind[own] != CODE[str]
                odd_ends = np.concatenate([[0], np.cumsum(odd)])[ends_of]
                keys = strings(places.key)
                for at_, to, values in ((own, ends_of, text_of(own)), (own[odd], odd_ends, kinds.take(pa.array(kind[own[odd]])))):
                    out.append(pa.MapArray.from_arrays(pa.array(np.append(to[some], to[-1]), pa.int32()), keys.take(pa.array(at[at_])), values))
            return pa.RecordBatch.from_arrays(out, list(columns))

        for i in range(len(texts)):
            places.walk(read(texts[i].as_py().lstrip())[0])
            ends.append(len(places.value))
            if places.seen >= _BATCH or i + 1 == len(texts):
                yield flush(i + 1)
                first, ends, places = i + 1, [0], _Places(some)


def _variant_text(scalar):
    """A number that is no 64-bit integer, as VARIANT writes it."""
    return F.try_variant_get(F.try_parse_json(scalar), "$", "string")


class _AtPointers:
    def __init__(self, pattern: str, within: str | None):
        self.pattern, self.within = pattern, within

    def wants(self, pointer: str) -> bool:
        import re

        return re.search(self.pattern, pointer) is not None

    def enters(self, pointer: str) -> bool:
        import re

        return re.search(self.within, pointer) is not None

    def __call__(self, places, at, kind):
        import numpy as np

        return np.fromiter(map(self.wants, places.pointer), bool, len(places.pointer))[at]


def at_pointers(*patterns: str, within: str | None = None) -> _AtPointers:
    """For ``flatten_json``: keeps the values whose pointer has a pattern, which is searched in each place of a batch once. Containers
    whose pointer lacks the pattern ``within``, if given, hold no such value below their members and aren't entered."""
    return _AtPointers("|".join(patterns), within)


def flatten_json(docs: DataFrame, column: str = "definition", once: bool = False, keep=None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """flow_id, pointer (RFC 6901), parent, key, depth, type and scalar of every value of every document; then, for ``field``, the
    scalar members of an object by key, and the types of those that are no strings.

    One walk a document, whatever its depth; documents that don't parse give no rows (see ``unparsable``), and Spark decides which do.
    Numbers that are no 64-bit integers get their type and text from VARIANT. The rows are written once, so that extractors scan only
    the columns and keys that they ask for; with ``once`` they aren't, for the only reader of them. ``keep`` and ``columns`` are what
    that reader filters by and reads: each document is walked as a whole, but only these values leave the walk.
    """
    text = docs.select("flow_id", F.col(column).alias("text")).where("try_parse_json(text) is not null")
    flow = text.schema["flow_id"].dataType.simpleString()
    columns = tuple(c for c in COLUMNS if c in {"flow_id", *columns, *(["kinds"] if "fields" in columns else ["fields"] if "kinds" in columns else []), *(["type"] if "scalar" in columns else ["scalar"] if "type" in columns else [])})
    walk = partial(_walk_batches, columns=columns, keep=keep)
    rows = text.mapInArrow(walk, ", ".join([f"flow_id {flow}", *(f"{c} {_TYPES[c]}" for c in columns[1:])]))
    if "type" in columns:
        number = F.col("type") == "NUMBER"
        kind = F.when(number, F.expr("regexp_extract(schema_of_variant(try_parse_json(scalar)), '^[A-Z]+', 0)")).otherwise(F.col("type"))
        scalar = F.when(number, _variant_text(F.col("scalar"))).otherwise(F.col("scalar"))
        rows = rows.select(*({"type": kind.alias("type"), "scalar": scalar.alias("scalar")}.get(c, c) for c in columns))
    return rows if once else materialize(rows, "json_path")


def field(name: str):
    """The scalar member of an object's row."""
    value = F.try_element_at("fields", F.lit(name))
    return F.when(F.try_element_at("kinds", F.lit(name)) == "NUMBER", _variant_text(value)).otherwise(value)


def text_field(name: str):
    """The string member of an object's row."""
    return F.when(F.try_element_at("kinds", F.lit(name)).isNull(), F.try_element_at("fields", F.lit(name)))


def unparsable(docs: DataFrame, column: str = "definition") -> DataFrame:
    return docs.where(F.expr(f"try_parse_json({column}) is null")).select("flow_id", F.lit("DEFINITION_UNREADABLE").alias("reason"))


def fields_of(paths: DataFrame, objects: DataFrame, fields: list[str]) -> DataFrame:
    """The scalar fields of the objects at flow_id, pointer, one row an object: from its own row, if that has them."""
    if "fields" in objects.columns:
        return objects.select("flow_id", "pointer", *(field(f).alias(f) for f in fields))
    rows = paths.where(F.col("key").isin(fields)).select("flow_id", F.col("parent").alias("pointer"), "key", "scalar")
    picked = rows.groupBy("flow_id", "pointer").agg(*(F.max(F.when(F.col("key") == f, F.col("scalar"))).alias(f) for f in fields))
    return objects.select("flow_id", "pointer").join(picked, ["flow_id", "pointer"], "left")


# What extractors read, as ``keep`` and ``columns`` of ``flatten_json``; their own patterns then hold as well. Readers of several kinds take
# the patterns of all. Java's ``$`` also stands ahead of a last line end, which such a pattern must leave room for.
_END = "(?:\r\n|[\n\r\x85\u2028\u2029])?$"
_OBJECT, _VALUE = ("pointer", "type", "fields"), ("pointer", "parent", "key", "type", "scalar")
NODE_AT, ENTRY_AT = "^/flowSequenceItemList/[0-9]+(?:/actionList/[^/]*|/menuChoiceList/[0-9]+/action[^/]*)?$", "^/manifest/[^/]+/[^/]*$"
_NODE_IN = "^/flowSequenceItemList(?:/[^/]*(?:/actionList(?:/[^/]*)?|/menuChoiceList(?:/[^/]*(?:/action[^/]*)?)?)?)?$"
_ENTRY_IN = "^/manifest(?:/[^/]*(?:/[^/]*)?)?$"
NODES = {"keep": at_pointers(NODE_AT, within=_NODE_IN), "columns": _OBJECT}
VARIABLES = {"keep": at_pointers("^/variables/[^/]*$", within="^/variables(?:/[^/]*)?$"), "columns": _OBJECT}
ENTRIES = {"keep": at_pointers(ENTRY_AT, within=_ENTRY_IN), "columns": _OBJECT}
REFERENCES = {"keep": at_pointers(NODE_AT, ENTRY_AT, "/(?:startAction|nextAction|menuReference|taskReference)$"), "columns": (*_OBJECT, *_VALUE)}
READS = {"keep": at_pointers(NODE_AT, f"/ref{_END[:-1]}/val$"), "columns": (*_OBJECT, *_VALUE)}
PROMPTS = {"keep": at_pointers(NODE_AT, ENTRY_AT, f"/ref{_END}"), "columns": _OBJECT}
SETTINGS = {"keep": at_pointers(NODE_AT, NODE_AT[:-1] + "/[^/]*$", within=_NODE_IN), "columns": (*_OBJECT, *_VALUE)}
WRAPPERS = {"keep": at_pointers(f"/config{_END[:-1]}/[^/]*$", "/operands$"), "columns": ("pointer", "parent", "key", "type")}


def extract_nodes(paths: DataFrame) -> DataFrame:
    """Containers and their actions, by position, with their identity and support level."""
    container = F.rlike("pointer", F.lit("^/flowSequenceItemList/[0-9]+$"))
    action = F.rlike("pointer", F.lit("^/flowSequenceItemList/[0-9]+/actionList/[0-9]+$|^/flowSequenceItemList/[0-9]+/menuChoiceList/[0-9]+/action$"))
    objects = paths.where("type = 'OBJECT'").where(container | action)
    rows = fields_of(paths, objects, ["__type", "trackingId", "id", "name"])
    kind = F.when(container, "container").otherwise("action")
    identity = F.concat(F.lit("nd_"), F.left(F.sha2(F.concat_ws("\x1f", "pointer", "__type", "name"), 256), F.lit(32)))
    tracked = F.when(F.rlike("trackingId", F.lit("^[0-9]+$")), F.concat(F.lit("trk_"), "trackingId"))
    level = F.when(F.col("__type").isin(KNOWN_TYPES), "full").otherwise("partial")
    return rows.select("flow_id", "pointer", F.coalesce(tracked, "id", identity).alias("node_id"), F.col("id").alias("source_id"), kind.alias("kind"), F.col("__type").alias("source_type"), "name", level.alias("support_level"))


def schema_deviations(paths: DataFrame) -> DataFrame:
    """Node positions that hold something other than an object."""
    spot = F.rlike("pointer", F.lit("^/flowSequenceItemList/[0-9]+(/actionList/[0-9]+)?$"))
    return paths.where(spot & (F.col("type") != "OBJECT")).select("flow_id", "pointer", "type")


REFERENCE_ROLES = {"startAction": "entry", "nextAction": "next", "menuReference": "transfer-menu", "taskReference": "transfer-task"}


def references(paths: DataFrame) -> DataFrame:
    """Known reference fields: flow_id, owner pointer, role, target source id."""
    role = F.create_map(*(F.lit(x) for p in REFERENCE_ROLES.items() for x in p))
    rows = paths.where(F.col("key").isin(list(REFERENCE_ROLES)) & F.col("scalar").isNotNull())
    return rows.select("flow_id", F.col("parent").alias("pointer"), F.element_at(role, F.col("key")).alias("role"), F.col("scalar").alias("target"))


def resolve(refs: DataFrame, nodes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """flow_id, edge_id, src, dst, role and outcome: edge, dependency or dangling."""
    src = nodes.select("flow_id", "pointer", F.col("node_id").alias("src"))
    dst = nodes.where("source_id is not null").select("flow_id", F.col("source_id").alias("target"), F.col("node_id").alias("dst"))
    known = dependencies.select("flow_id", F.col("dependency_id").alias("target"), F.lit(True).alias("known")).distinct()
    rows = refs.join(src, ["flow_id", "pointer"]).join(dst, ["flow_id", "target"], "left").join(known, ["flow_id", "target"], "left")
    outcome = F.when(F.col("dst").isNotNull(), "edge").when(F.col("known"), "dependency").otherwise("dangling")
    edge_id = F.concat("src", F.lit("->"), F.coalesce("dst", "target"), F.lit("#"), "role", F.lit("@"), "pointer")
    return rows.select("flow_id", edge_id.alias("edge_id"), "src", F.coalesce("dst", "target").alias("dst"), "role", outcome.alias("outcome"))


def branch_role(output_id, dynamic=None):
    """The role of a path by its output: any name but an id, without its underscores, in lower case; else dynamic-branch or branch."""
    bare = F.lower(F.regexp_replace(output_id, "^__+|__+$", ""))
    named = output_id.isNotNull() & ~F.rlike(output_id, F.lit(GUID_LIKE)) & (F.length(bare) > 0)
    return F.when(named, bare).when(F.coalesce(dynamic if dynamic is not None else F.lit(False), F.lit(False)), "dynamic-branch").otherwise("branch")


def extract_variables(paths: DataFrame) -> DataFrame:
    objects = paths.where("type = 'OBJECT'").where(F.rlike("pointer", F.lit("^/variables/[0-9]+$")))
    rows = fields_of(paths, objects, ["__type", "id", "name", "isInput", "isOutput"])
    bare = F.regexp_replace("__type", "Variable$", "")
    data_type = F.concat(F.lower(F.left(bare, F.lit(1))), F.substr(bare, F.lit(2)))
    on = lambda c: F.coalesce(F.col(c) == "true", F.lit(False))
    direction = F.when(on("isInput") & on("isOutput"), "input-output").when(on("isInput"), "input").when(on("isOutput"), "output").otherwise("local")
    return rows.select("flow_id", F.col("id").alias("variable_id"), "name", data_type.alias("data_type"), direction.alias("direction"))


def variable_reads(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Variable references with the node that owns them: the longest node pointer that is a prefix, by equality on the
    first four or five pointer parts."""
    return _owned(paths.where("key = 'val' and scalar is not null").where(F.rlike("parent", F.lit("/ref$"))), nodes)


def _owned(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    cut = lambda n: F.array_join(F.slice(F.split("pointer", "/"), 1, n), "/")
    rows = refs.select("flow_id", F.col("scalar").alias("variable_id"), F.explode(F.array(cut(3), cut(5), cut(6))).alias("owner"), F.col("pointer").alias("site"))
    own = nodes.select("flow_id", F.col("pointer").alias("owner"), "node_id")
    best = rows.join(own, ["flow_id", "owner"]).groupBy("flow_id", "site", "variable_id").agg(F.max_by("node_id", F.length("owner")).alias("node_id"))
    return best.select("flow_id", "variable_id", "node_id").distinct()


def manifest_entries(paths: DataFrame) -> DataFrame:
    """flow_id, type, dependency_id, display_name and pointer of every manifest entry with an id."""
    objects = paths.where("type = 'OBJECT'").where(F.rlike("pointer", F.lit("^/manifest/[^/]+/[0-9]+$")))
    rows = fields_of(paths, objects, ["id", "name"])
    kind = F.regexp_extract("pointer", "^/manifest/([^/]+)/", 1)
    return rows.where(F.length(F.trim("id")) > 0).select("flow_id", kind.alias("type"), F.col("id").alias("dependency_id"), F.col("name").alias("display_name"), "pointer")


def extract_dependencies(paths: DataFrame) -> DataFrame:
    return manifest_entries(paths).drop("pointer").dropDuplicates(["flow_id", "type", "dependency_id"])


def build_evidence(nodes: DataFrame) -> DataFrame:
    """Two rows a node; the id hashes pointer, NUL and field."""
    rows = nodes.select("flow_id", "node_id", "pointer", F.explode(F.array(F.struct(F.lit("name").alias("field"), F.col("name").alias("value")), F.struct(F.lit("__type").alias("field"), F.col("source_type").alias("value")))).alias("f"))
    return rows.select("flow_id", F.sha2(F.concat("pointer", F.lit("\x00"), "f.field"), 256).alias("evidence_id"), "node_id", "f.field", "f.value")


def parse_value_refs(paths: DataFrame) -> DataFrame:
    """One row a wrapper {config: {kind: ...}}: literal, unset, null, variableRef, expression or opaque."""
    kinds = paths.where(F.rlike("parent", F.lit("/config$"))).groupBy("flow_id", F.col("parent").alias("pointer")).agg(F.min("key").alias("key"), F.min("pointer").alias("child"))
    calls = paths.where("key = 'operands' and type = 'ARRAY'").select("flow_id", F.col("parent").alias("child"), F.lit(True).alias("call"))
    state = F.when(F.col("key") == "lit", "literal").when(F.col("key") == "emp", "unset").when(F.col("key") == "nul", "null").when(F.col("key") == "ref", "variableRef").when(F.col("call"), "expression").otherwise("opaque")
    return kinds.join(calls, ["flow_id", "child"], "left").select("flow_id", "pointer", state.alias("state"))

# Fields that hold ids without being references.
NOT_REFERENCES = ["id", "trackingId", "startAction", "nextAction", "menuReference", "taskReference", "outputId"]
GUID_LIKE = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def generic_references(paths: DataFrame, pattern: str = GUID_LIKE) -> DataFrame:
    """Id-shaped strings outside known fields and outside value wrappers: owner pointer, role by field name, target."""
    rows = paths.where(F.rlike("scalar", F.lit(pattern)) & ~F.col("key").isin(NOT_REFERENCES) & ~F.contains("pointer", F.lit("/config/")) & ~F.startswith("pointer", F.lit("/manifest/")))
    field = F.when(F.rlike("key", F.lit("^[0-9]+$")), F.element_at(F.split("parent", "/"), -1)).otherwise(F.col("key"))
    return rows.select("flow_id", "pointer", "parent", field.alias("field"), F.col("scalar").alias("target"))


# Dependency types that are prompts, and the type of a reference to one.
PROMPT_TYPES, PROMPT_REFERENCE = ["userPrompt", "systemPrompt"], "pmt"


def prompt_references(paths: DataFrame, nodes: DataFrame, dependencies: DataFrame, contexts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(flow_id, node_id, prompt_id of the prompts that a node uses; a DANGLING_REFERENCE for each inline reference to none).

    A node uses the prompts that its values refer to, by a reference of type pmt, and those whose manifest entry names it in
    contexts (flow_id, dependency_id, node_id)."""
    prompts = dependencies.where(F.col("type").isin(PROMPT_TYPES)).select("flow_id", F.col("dependency_id").alias("prompt_id")).distinct()
    refs = paths.where("type = 'OBJECT'").where(F.rlike("pointer", F.lit("/ref$")) & (text_field("type") == PROMPT_REFERENCE))
    refs = refs.select("flow_id", F.concat("pointer", F.lit("/val")).alias("pointer"), field("val").alias("scalar")).where("scalar is not null")
    inline = _owned(refs, nodes).select("flow_id", "node_id", F.col("variable_id").alias("prompt_id"))
    uses = inline.join(prompts, ["flow_id", "prompt_id"], "left_semi").select("flow_id", "node_id", "prompt_id")
    if contexts is not None:
        uses = uses.unionByName(contexts.select("flow_id", "node_id", F.col("dependency_id").alias("prompt_id")).join(prompts, ["flow_id", "prompt_id"], "left_semi").select("flow_id", "node_id", "prompt_id")).distinct()
    lost = inline.join(prompts, ["flow_id", "prompt_id"], "left_anti").select("flow_id", "node_id", F.lit("DANGLING_REFERENCE").alias("code"))
    return uses, lost


def settings(paths: DataFrame, nodes: DataFrame, excluded: list[str], most: int = 4000) -> DataFrame:
    """Node-local scalars that are neither excluded nor ids, cut to 500 characters; the last keys go first beyond a byte budget."""
    from pyspark.sql import Window

    own = nodes.select("flow_id", "node_id", F.col("pointer").alias("parent"))
    rows = paths.where(F.col("scalar").isNotNull() & ~F.col("key").isin(excluded) & ~F.rlike("scalar", F.lit(GUID_LIKE))).join(own, ["flow_id", "parent"])
    rows = rows.select("flow_id", "node_id", "key", F.left("scalar", F.lit(500)).alias("value"))
    used = F.sum(F.octet_length("key") + F.octet_length("value")).over(Window.partitionBy("flow_id", "node_id").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= most).drop("used")


def finalize_warnings(warning: DataFrame) -> DataFrame:
    return warning.withColumn("node_ids", F.array_sort("node_ids")).dropDuplicates(["flow_id", "code", "path", "node_ids", "message"])


def collect_languages(rows: DataFrame) -> DataFrame:
    """Lower-cased union of the supported and default languages of each flow."""
    each = rows.select("flow_id", F.explode(F.array_compact(F.concat(F.coalesce("supported", F.array().cast("array<string>")), F.array("default")))).alias("l"))
    return each.groupBy("flow_id").agg(F.array_sort(F.collect_set(F.lower("l"))).alias("languages"))


def describe_expressions(paths: DataFrame, max_depth: int = 6, most: int = 200) -> DataFrame:
    """Text of every expression wrapper, op(a, b), built bottom-up: a join a level."""
    at = paths.where("key = 'operands' and type = 'ARRAY'").select("flow_id", F.col("parent").alias("op_at"), F.col("pointer").alias("list"))
    args = paths.select("flow_id", F.col("parent").alias("list"), F.col("pointer").alias("arg"), F.col("key").cast("int").alias("i")).join(at, ["flow_id", "list"])
    leaf = paths.where("key in ('text', 'val') and scalar is not null")
    known = leaf.select("flow_id", F.regexp_replace("parent", "/config/(lit|ref)$", "").alias("arg"), F.col("scalar").alias("text"))
    name = lambda p: F.element_at(F.split(p, "/"), -1)
    for _ in range(max_depth):
        done = args.join(known, ["flow_id", "arg"], "left").groupBy("flow_id", "op_at").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("text", F.lit("?")).alias("t")))).alias("parts"), F.count_if(F.col("text").isNull()).alias("open"))
        text = F.concat(name(F.col("op_at")), F.lit("("), F.array_join(F.transform("parts", lambda x: x["t"]), ", "), F.lit(")"))
        made = done.where("open = 0").select("flow_id", F.regexp_replace("op_at", "/config/[^/]+$", "").alias("arg"), text.alias("text"))
        known = materialize(known.unionByName(made).distinct(), "expressions")
    return made.select("flow_id", F.col("arg").alias("pointer"), F.left("text", F.lit(most)).alias("text"))
