"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder stands in for it on a local master only."""
    global _local_root
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    _local_root = _local_root or tempfile.mkdtemp(prefix="flowlake-")
    return _local_root


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and return a scan of it: the lineage ends there, so a
    lost executor costs a reread and several readers cost one computation. Readers of some values of ``by`` read only their files."""
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._flowlake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that no later step reads."""
    path = getattr(df, "_flowlake_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
