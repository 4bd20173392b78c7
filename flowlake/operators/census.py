"""Census of a corpus of documents: what a type's flows hold, and what no rule models yet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.operators.normalize import KNOWN_TYPES

# Manifest categories and value wrappers that are modelled; operators have names that start with a capital or a sign.
KNOWN_MANIFEST = ["dataAction", "queue", "ttsEngine", "ttsVoice", "language", "userPrompt", "systemPrompt"]
KNOWN_WRAPPERS, OPERATOR = ["lit", "emp", "ref", "sysref"], "^[A-Z_=<>!+*/-]"
NODE = "^/flowSequenceItemList/[0-9]+(/actionList/[0-9]+|/menuChoiceList/[0-9]+/action)?$"


def _listed(paths: DataFrame) -> DataFrame:
    """Flows whose sequence is a list."""
    return paths.where((F.col("pointer") == "/flowSequenceItemList") & (F.col("type") == "ARRAY")).select("flow_id")


def _nodes(paths: DataFrame) -> DataFrame:
    """flow_id, pointer, source_type (UNKNOWN without one) and tracked of every node."""
    nodes = paths.where(F.rlike("pointer", F.lit(NODE)) & F.col("type").isin("OBJECT", "ARRAY")).select("flow_id", "pointer")
    nodes = nodes.join(_listed(paths), "flow_id", "left_semi")
    fields = paths.where(F.col("key").isin("__type", "trackingId") & F.rlike("parent", F.lit(NODE)))
    held = fields.groupBy("flow_id", F.col("parent").alias("pointer")).agg(F.max(F.when(F.col("key") == "__type", F.col("scalar"))).alias("source_type"), F.bool_or(F.col("key") == "trackingId").alias("tracked"))
    return nodes.join(held, ["flow_id", "pointer"], "left").select("flow_id", "pointer", F.coalesce("source_type", F.lit("UNKNOWN")).alias("source_type"), F.coalesce("tracked", F.lit(False)).alias("tracked"))


def corpus_census(flow: DataFrame, paths: DataFrame) -> DataFrame:
    """One row a type of flow(flow_id, type): flows, those with a sequence, nodes, tracked nodes, and flows whose nodes are not all tracked."""
    listed = _listed(paths).withColumn("listed", F.lit(1))
    counts = _nodes(paths).groupBy("flow_id").agg(F.count("*").alias("nodes"), F.count_if("tracked").alias("tracked"))
    rows = flow.join(listed, "flow_id", "left").join(counts, "flow_id", "left").fillna(0, ["listed", "nodes", "tracked"])
    loose = (F.col("listed") == 1) & ((F.col("nodes") == 0) | (F.col("tracked") < F.col("nodes")))
    return rows.groupBy("type").agg(F.count("*").alias("flows"), F.sum("listed").alias("with_sequence"), F.sum("nodes").alias("nodes"), F.sum("tracked").alias("tracked"), F.count_if(loose).alias("not_all_tracked"))


def unknown_names(flow: DataFrame, paths: DataFrame) -> DataFrame:
    """type, kind (node type, manifest key or wrapper), name, number of places and of flows of every name that no rule models."""
    nodes = _nodes(paths).where(~F.col("source_type").isin(KNOWN_TYPES)).select("flow_id", F.lit("node type").alias("kind"), F.col("source_type").alias("name"))
    keys = paths.where((F.col("parent") == "/manifest") & ~F.col("key").isin(KNOWN_MANIFEST)).select("flow_id", F.lit("manifest key").alias("kind"), F.col("key").alias("name"))
    wrappers = paths.where(F.endswith("parent", F.lit("/config"))).groupBy("flow_id", "parent").agg(F.min("key").alias("name"))
    wrappers = wrappers.where(~F.col("name").isin(KNOWN_WRAPPERS) & ~F.rlike("name", F.lit(OPERATOR))).select("flow_id", F.lit("wrapper").alias("kind"), "name")
    each = reduce(DataFrame.unionByName, (nodes, keys, wrappers)).groupBy("flow_id", "kind", "name").agg(F.count("*").alias("places"))
    return each.join(flow, "flow_id").groupBy("type", "kind", "name").agg(F.sum("places").alias("places"), F.count("*").alias("flows"))
