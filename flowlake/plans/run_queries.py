"""Runs that are written, replayed and read back: snapshots, streams of discovery and of retirement."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowlake.operators.incremental import confirm_retired
from flowlake.plans.registry import query
from flowlake.plans.snapshot_queries import DECIDED
from flowlake.plans.views import CUT, manifest_pair, table
from flowlake.sources import snapshots as S
from flowlake.streaming import changes as T
from flowlake.tables import shared_root


def _folder(spark, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _orders(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 3).alias("organization"), F.col("o_custkey").alias("flow_id"), F.col("o_orderpriority").alias("version"), F.col("o_orderkey").alias("node_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("at"))


RUNS = f"""WITH o AS (SELECT o_custkey % 3 AS organization, o_custkey AS flow_id, o_orderpriority AS version, o_orderkey AS node_id, o_orderstatus AS state, o_orderdate < TIMESTAMP '{CUT}' AS old FROM orders),
touched AS (SELECT DISTINCT flow_id, version FROM o WHERE NOT old AND flow_id % 2 = 0)"""


@query(RUNS + """ SELECT organization, flow_id, version, node_id, state, CASE WHEN old THEN 'first' ELSE 'second' END AS run_id FROM o
  WHERE flow_id % 7 <> 0 AND CASE WHEN old THEN NOT EXISTS (FROM touched t WHERE t.flow_id = o.flow_id AND t.version = o.version) ELSE flow_id % 2 = 0 END""")
def r9_merge_unchanged(spark, d):
    """A first run of all old orders; a second that touches some flows and takes some out; the table as a reader then sees it. A third run
    is staged and never published."""
    root, rows, cut = _folder(spark, "snapshot"), _orders(spark, d), F.lit(CUT).cast("timestamp")
    S.write_snapshot({"node": rows.where(F.col("at") < cut).drop("at")}, root, "first")
    S.write_snapshot({"node": rows.where((F.col("at") >= cut) & (F.col("flow_id") % 2 == 0)).drop("at")}, root, "second", gone=rows.where("flow_id % 7 = 0"))
    S.stage({"node": rows.where("flow_id % 5 = 0").drop("at")}, root, "third")
    return S.read_snapshot(spark, root, "node")


@query(DECIDED + " SELECT flow_id, n.version, n.division, n.hash FROM plan JOIN discovered n USING (flow_id) WHERE bucket = 'capture' UNION ALL SELECT p.flow_id, p.version, p.division, p.hash FROM previous p JOIN plan q ON q.flow_id = p.flow_id AND q.bucket NOT IN ('capture', 'retire')")
def c9_stream_flow_changes(spark, d):
    """The discovered rows land in two parts, of any number of files each, and the stream goes on from its checkpoint behind each; its last
    run is the snapshot that the batch rule gives for both at once."""
    previous, found = manifest_pair(spark, d)
    root = _folder(spark, "stream")
    for part in (0, 1):
        found.where(F.col("flow_id") % 2 == part).write.mode("append").parquet(f"{root}/in")
        landed = spark.readStream.schema(found.schema).parquet(f"{root}/in")
        T.stream_flow_changes(landed, previous, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out/snapshot").where(F.col("run_id") == 1).drop("run_id")


RETIRED = """WITH run AS (SELECT user_id AS flow_id, date_trunc('day', ts) AS run, bool_and(event_type <> 'purchase') AS absent FROM events GROUP BY ALL)
SELECT flow_id, run FROM (SELECT *, lag(absent) OVER (PARTITION BY flow_id ORDER BY run) AS before FROM run) WHERE absent AND before"""


def _daily(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").cast("long").alias("flow_id"), F.date_trunc("day", "ts").alias("run")).agg(F.every(F.col("event_type") != "purchase").alias("absent"))


@query(RETIRED)
def w7_retire_daily(spark, d):
    return confirm_retired(_daily(spark, d))


@query(RETIRED)
def c10_retire_replay(spark, d):
    """The same rule as a stream over the landed runs, with state by flow."""
    root = _folder(spark, "retire")
    _daily(spark, d).write.parquet(f"{root}/in")
    landed = spark.readStream.schema("flow_id long, run timestamp, absent boolean").parquet(f"{root}/in")
    T.stream_retire_confirmation(landed).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("flow_id long, run timestamp").parquet(f"{root}/out")
