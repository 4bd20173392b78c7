"""The stream of discovery lands its parts from as many tasks as Spark deals them to."""

from pyspark.sql import functions as F

from flowlake.plans import run_queries as Q


def test_parts_land_without_a_single_task(spark, monkeypatch):
    """Each part was joined and written by one task, whose memory grew with the input."""
    previous = spark.createDataFrame([(1, 1, "a", "h"), (2, 1, "a", "h")], "flow_id long, version long, division string, hash string")
    found = spark.range(1, 41).select(F.col("id").alias("flow_id"), F.lit("found").alias("status"), F.lit(2).cast("long").alias("version"), F.lit("b").alias("division"), F.lit("g").alias("hash")).repartition(3)
    monkeypatch.setattr(Q, "manifest_pair", lambda *_: (previous, found))
    monkeypatch.setattr(type(found), "coalesce", lambda *_: (_ for _ in ()).throw(AssertionError("one task")))
    out = Q.c9_stream_flow_changes(spark, "").collect()
    assert sorted((r.flow_id, r.version) for r in out) == [(k, 2) for k in range(1, 41)]
