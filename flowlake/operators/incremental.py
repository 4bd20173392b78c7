"""What an incremental run must do with each flow, and what it carries forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decide(previous: DataFrame, discovered: DataFrame, rebuild: bool = False) -> DataFrame:
    """flow_id, action and bucket; the first matching rule wins. previous(flow_id, version, division, hash),
    discovered(flow_id, status, version, division, hash)."""
    old = previous.select("flow_id", F.lit(True).alias("known"), *(F.col(c).alias(f"old_{c}") for c in ("version", "division", "hash")))
    rows = old.join(discovered, "flow_id", "full_outer")
    same = F.col("version").eqNullSafe(F.col("old_version")) & F.col("division").eqNullSafe(F.col("old_division"))
    action = (
        F.when(F.col("status").isNull(), "not-in-scope").when(F.col("status") == "forbidden", "inaccessible").when(F.col("status") == "not-found", "retire-candidate")
        .when(F.col("known").isNull(), "new-flow").when(F.lit(rebuild), "rebuild-forced").when(same, "skip-unchanged")
        .when(F.col("hash").isNull(), "regenerate-pending").when(F.col("hash").eqNullSafe(F.col("old_hash")), "metadata-only").otherwise("regenerate")
    )
    bucket = F.when(F.col("action").isin("skip-unchanged"), "skip").when(F.col("action") == "retire-candidate", "retire")
    bucket = bucket.when(F.col("action").isin("inaccessible", "not-in-scope"), F.col("action")).otherwise("capture")
    return rows.withColumn("action", action).withColumn("bucket", bucket)


def metadata_notes(previous: DataFrame, found: DataFrame) -> DataFrame:
    """flow_id and notes of flows that both sides (flow_id, division, type, name) have; an unknown old name is no change."""
    old = previous.select("flow_id", *(F.col(c).alias(f"old_{c}") for c in ("division", "type", "name")))
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    notes = [F.when(differs("division"), "DIVISION_CHANGED"), F.when(differs("type"), "TYPE_CHANGED"), F.when(F.col("old_name").isNotNull() & differs("name"), "DISPLAY_NAME_CHANGED")]
    return found.join(old, "flow_id").select("flow_id", F.array_compact(F.array(*notes)).alias("notes"))


def carry_forward(previous: DataFrame, decided: DataFrame, captured: DataFrame) -> DataFrame:
    """The new run's rows: captured ones, and previous ones that are not captured anew or retired, whole."""
    gone = decided.where("bucket in ('capture', 'retire')").select("flow_id")
    return captured.withColumn("carried", F.lit(False)).unionByName(previous.join(gone, "flow_id", "left_anti").withColumn("carried", F.lit(True)))


def merge_unchanged(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace those of the keys they touch; all others stay."""
    return existing.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def resume_skip(jobs: DataFrame, journal: DataFrame) -> DataFrame:
    """Jobs whose last journal entry (by ord) is not completed."""
    last = journal.groupBy("job").agg(F.max_by("status", "ord").alias("status")).where("status = 'completed'")
    return jobs.join(last, "job", "left_anti")


def latest_version(versions: DataFrame, order: str, mode: str = "numeric") -> DataFrame:
    """One row a flow: the greatest version as a number, or with mode lexical as text."""
    by = F.col(order).cast("string") if mode == "lexical" else F.expr(f"try_cast({order} AS DECIMAL(38, 9))")
    w = Window.partitionBy("flow_id").orderBy(by.desc_nulls_last(), F.desc(order))
    return versions.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def confirm_retired(runs: DataFrame) -> DataFrame:
    """flow_id and run of flows absent in two consecutive runs: runs(flow_id, run, absent)."""
    w = Window.partitionBy("flow_id").orderBy("run")
    return runs.withColumn("before", F.lag("absent").over(w)).where("absent and before").select("flow_id", "run")


def plan_selection(flows: DataFrame, previous: DataFrame, cap: int) -> DataFrame:
    """One row: flows selected, changed and unchanged against the previous run, whether over the cap, and a plan hash
    that doesn't depend on the order of rows."""
    old = previous.select("flow_id", F.col("version").alias("old_version"))
    rows = flows.select("flow_id", "version").join(old, "flow_id", "left")
    same = F.col("version").eqNullSafe(F.col("old_version"))
    row = F.xxhash64(F.col("flow_id").cast("string"), F.col("version").cast("string")).cast("decimal(20,0)")
    out = rows.agg(F.count("*").alias("selected"), F.count_if(~same).alias("changed"), F.count_if(same).alias("unchanged"), F.sum(row).cast("string").alias("_sum"))
    digest = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", "selected", F.coalesce("_sum", F.lit("0"))), 256))
    return out.withColumn("over_cap", F.col("selected") > cap).withColumn("plan_hash", digest).drop("_sum")


def run_results(decided: DataFrame, failed: DataFrame) -> DataFrame:
    """One row a flow: its status in the run, an issue code and whether its source changed; failures come first."""
    bad = failed.select("flow_id", "issue_code")
    status = F.when(F.col("issue_code").isNotNull(), "failed").when(F.col("bucket") == "capture", "captured").when(F.col("bucket") == "skip", "carried-forward").otherwise(F.col("bucket"))
    changed = F.coalesce(F.col("action").isin("new-flow", "regenerate", "regenerate-pending"), F.lit(False))
    return decided.join(bad, "flow_id", "left").select("flow_id", status.alias("status"), "issue_code", changed.alias("source_changed"))
