"""Positions in an order of all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.tables import materialize

GROUP = 1024


def running_start(sizes: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """sizes with ``start``: the sum of ``size`` over the rows of the same keys that come before in ``order`` (an integer from 0,
    once for each keys). Sums of groups of GROUP are added up first, so that a window has few rows."""
    group = F.floor(F.col(order) / GROUP).alias("_group")
    inner = Window.partitionBy(*keys, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.withColumn("_group", group)
    before = own.groupBy(*keys, "_group").agg(F.sum(size).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(outer), F.lit(0)))
    inside = own.withColumn("_inside", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    a, b = inside.alias("a"), before.alias("b")
    same = F.col("a._group") == F.col("b._group")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select(*(f"a.{c}" for c in sizes.columns), (F.col("a._inside") + F.col("b._before")).alias("start"))


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with ``rank``: the place of each row, from 0, among the rows of its keys (null is a key) in ascending order, nulls first.
    Rows are sorted by range and counted a task and key; a key of many rows lies in as many tasks as it needs. ``order`` should tell
    rows apart, or equal ones meet in one task."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    # within a task the low 33 bits count the rows in their order, the others are the task's number
    placed = materialize(numbered.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_pos")).drop("_at"), "ranked")
    sizes = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    starts = running_start(sizes, keys, "_part", "_n").select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_of"), "_first", "start")
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(starts, same).select(*df.columns, (F.col("_pos") - F.col("_first") + F.col("start")).alias("rank"))
