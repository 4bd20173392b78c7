"""Snapshot runs that are published as a whole and replace only what they touch.

A run writes the rows of the keys that it touches, once, under ``<table>/run_id=<run>``; the ``index`` of the run says for each key which
run holds its rows (its own for touched keys, as before for all others), and the last step adds a pointer row. A reader follows the
latest pointer, so a run that died before it is as if it never was, and unchanged flows are never copied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.operators.incremental import merge_unchanged

KEY = ["organization", "flow_id", "version"]


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def current_run(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Number and name of the run that the latest pointer names."""
    pointers = _read(spark, f"{root}/pointer")
    return None if pointers is None else tuple(pointers.orderBy(F.desc("at")).select("at", "run").first())


def is_published(spark: SparkSession, root: str, run_id: str) -> bool:
    pointers = _read(spark, f"{root}/pointer")
    return pointers is not None and not pointers.where(F.col("run") == run_id).isEmpty()


def stage(tables: dict[str, DataFrame], root: str, run_id: str, key: list[str] = KEY, gone: DataFrame | None = None) -> None:
    """Write a run's rows and index without publishing them: a run staged again replaces itself, and one that is published stays as it is. A key is touched when any table has
    rows of it; ``gone`` are keys that the run takes out. A key touched in one table is replaced in all."""
    spark = next(iter(tables.values())).sparkSession
    if is_published(spark, root, run_id):
        return
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")
    own = reduce(DataFrame.unionByName, [spark.read.parquet(f"{root}/{name}/run_id={run_id}").select(*key) for name in tables]).distinct().withColumn("held_by", F.lit(run_id))
    now = current_run(spark, root)
    if now is not None:
        own = merge_unchanged(spark.read.parquet(f"{root}/index/run={now[1]}"), own, key)
    if gone is not None:
        own = own.join(gone.select(*key).distinct(), key, "left_anti")
    own.write.mode("overwrite").parquet(f"{root}/index/run={run_id}")


def publish(spark: SparkSession, root: str, run_id: str) -> None:
    """Make a staged run the current one, unless it is published already."""
    now = current_run(spark, root)
    if not is_published(spark, root, run_id):
        spark.createDataFrame([(0 if now is None else now[0] + 1, run_id)], "at long, run string").coalesce(1).write.mode("append").parquet(f"{root}/pointer")


def write_snapshot(tables: dict[str, DataFrame], root: str, run_id: str, key: list[str] = KEY, gone: DataFrame | None = None) -> None:
    stage(tables, root, run_id, key, gone)
    publish(next(iter(tables.values())).sparkSession, root, run_id)


def read_snapshot(spark: SparkSession, root: str, name: str, key: list[str] = KEY) -> DataFrame:
    """The rows of a table in the current run, with the run that holds each; only the runs that the index names are read."""
    now = current_run(spark, root)
    if now is None:
        raise ValueError(f"no run is published in {root}")
    index = spark.read.parquet(f"{root}/index/run={now[1]}").select(*key, F.col("held_by").alias("run_id"))
    rows = spark.read.option("mergeSchema", True).parquet(f"{root}/{name}").withColumn("run_id", F.col("run_id").cast("string"))
    return rows.join(index, [*key, "run_id"], "left_semi")
