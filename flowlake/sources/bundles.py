"""Reading captured bundles and writing snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bundle_flows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(flows with flow_id, version, format and definition; skipped ones with a reason) of flows/<id>/versions/<v>/definition.*."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("content").cast("string").alias("text"))
    part = lambda p, n: F.nullif(F.regexp_extract("path", p, n), F.lit(""))
    version = r"flows/([^/]+)/versions/([^/]+)/definition\.(json|yaml)$"
    defs = files.where(F.rlike("path", F.lit(version))).select(part(version, 1).alias("flow_id"), part(version, 2).alias("version"), part(version, 3).alias("format"), F.col("text").alias("definition"))
    meta = files.where(F.rlike("path", F.lit(r"flows/[^/]+/flow\.json$"))).select(part(r"flows/([^/]+)/flow\.json$", 1).alias("flow_id"), F.col("text").alias("meta"))
    rows = meta.join(defs, "flow_id", "full_outer")
    reason = F.when(F.col("meta").isNull(), "flow-missing").when(F.col("definition").isNull(), "definition-missing").when(F.col("format") == "yaml", "format-unsupported")
    reason = reason.when(F.expr("try_parse_json(definition)").isNull(), "definition-unreadable")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("flow_id", "version", "reason")


def read_resource_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """node and edge of one resource-graph JSON."""
    raw = spark.read.schema("nodes array<struct<key string, type string, id string, displayName string, resolutionStatus string>>, edges array<struct<`from` string, `to` string, viaNodeId string, viaField string>>").json(path, multiLine=True)
    node = raw.select(F.explode("nodes").alias("n")).select("n.key", "n.type", "n.id", F.col("n.displayName").alias("display_name"), F.col("n.resolutionStatus").alias("status"))
    edge = raw.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.viaNodeId").alias("via_node_id"), F.col("e.viaField").alias("via"))
    return node, edge


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"), F.col("length").alias("byte_length"))


def data_table_rows(rows: DataFrame, key: str, order: str, most: int = 2000) -> DataFrame:
    """At most 2,000 rows of each data table, as the source caps them."""
    from pyspark.sql import Window

    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= most).drop("_r")


def seal_bundle(flows: DataFrame, resources: DataFrame, node: DataFrame, assets: DataFrame, mode: str = "migration", assets_captured: bool = True, truncated: bool = False) -> DataFrame:
    """One manifest row: counts, a content hash over all rows that doesn't depend on their order, caveats, and whether the bundle can be
    imported: migration mode, with flows, every reference read. node(type, status, ...), assets(digest, byte_length)."""
    from flowlake.operators.quality import table_hash

    hashes = None
    for name, df in (("assets", assets), ("flows", flows), ("graph", node), ("resources", resources)):
        one = table_hash(df).select(F.lit(name).alias("part"), "rows", "content_hash")
        hashes = one if hashes is None else hashes.unionByName(one)
    count = lambda name: F.max(F.when(F.col("part") == name, F.col("rows"))).alias(name)
    digest = F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content_hash"))), lambda e: e["content_hash"]), "|"), 256))
    counts = hashes.agg(count("flows"), count("resources"), count("assets"), digest.alias("content_hash"))
    missing = node.where("status <> 'resolved'").agg(F.count("*").alias("unresolved"), F.array_sort(F.collect_set("type")).alias("unresolved_types"))
    size = assets.agg(F.coalesce(F.sum("byte_length"), F.lit(0)).alias("asset_bytes"))
    out = counts.crossJoin(missing).crossJoin(size)  # one row each
    migration = F.lit(mode == "migration")
    caveats = [F.when(F.lit(truncated), "GRAPH_TRUNCATED"), F.when(F.lit(not assets_captured), "ASSETS_NOT_CAPTURED"), F.when(F.lit(mode == "context"), "CONTEXT_MODE"), F.when(migration & (F.col("unresolved") > 0), "REFERENCES_UNREAD")]
    return out.withColumn("caveats", F.array_compact(F.array(*caveats))).withColumn("importable", migration & (F.col("flows") > 0) & (F.col("unresolved") == 0))
