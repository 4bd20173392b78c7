"""Incremental capture as streams: the batch rules on each micro-batch, and retirement as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from flowlake.operators import incremental as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _run_before(spark: SparkSession, out: str, epoch: int) -> int | None:
    """The latest finished run of an earlier epoch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/snapshot/run_id=*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    runs = [int(f.getPath().getParent().getName().partition("=")[2]) for f in found]
    return max((r for r in runs if r < epoch), default=None)


def decide_batch(previous: DataFrame, out: str):
    """What ``foreachBatch`` does with newly landed rows of (flow_id, status, version, division, hash), one a flow: decide on each against
    the run before (``previous`` at first), and carry forward what the batch doesn't replace or retire.

    A run reads only runs of earlier epochs and overwrites its own folders, so an epoch that is done again, because the driver died between
    its writes and the commit, leaves the same tables."""

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        last = _run_before(spark, out, epoch)
        before = previous if last is None else spark.read.parquet(f"{out}/snapshot/run_id={last}")
        decided = C.decide(before, rows)
        decided.select("flow_id", "action", "bucket").write.mode("overwrite").parquet(f"{out}/decisions/run_id={epoch}")
        captured = rows.join(decided.where("bucket = 'capture'").select("flow_id"), "flow_id", "left_semi").select(*before.columns)
        C.carry_forward(before, decided, captured).drop("carried").write.mode("overwrite").parquet(f"{out}/snapshot/run_id={epoch}")

    return batch


def stream_flow_changes(discovered: DataFrame, previous: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Decisions and the carried-forward snapshot of every newly landed discovery batch, a run an epoch."""
    return discovered.writeStream.foreachBatch(decide_batch(previous, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Retirement(StatefulProcessor):
    """A flow's last run and how often running it was absent, forgotten when no run has named it for ``keep_ms``."""

    def __init__(self, needed: int, keep_ms: int):
        self.needed, self.keep_ms = needed, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, streak int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, streak = self.seen.get() if self.seen.exists() else (None, 0)
        found = []
        for r in pd.concat(list(rows)).sort_values("run").itertuples():
            at = r.run.value // 1000
            if last is not None and at <= last:  # late or repeated
                continue
            last, streak = at, streak + 1 if r.absent else 0
            if streak >= self.needed:
                found.append(r.run)
        self.seen.update((last, streak))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.handle.registerTimer(last // 1000 + self.keep_ms)
        yield pd.DataFrame({"flow_id": pd.Series([key[0]] * len(found), dtype="int64"), "run": pd.Series(found, dtype="datetime64[ns]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame({"flow_id": pd.Series([], dtype="int64"), "run": pd.Series([], dtype="datetime64[ns]")})

    def close(self) -> None:
        pass


def stream_retire_confirmation(runs: DataFrame, delay: str = "7 days", needed: int = 2, keep_ms: int = 90 * 86_400_000) -> DataFrame:
    """flow_id and run at which a flow was absent ``needed`` times running: runs(flow_id long, run timestamp, absent).

    State is keyed by flow, in RocksDB; rows behind the watermark (``delay`` behind the latest run) are dropped, and a flow's state goes once
    the watermark has passed its last run by ``keep_ms``."""
    conf = runs.sparkSession.conf
    if conf.get(PROVIDER, ROCKSDB) != ROCKSDB or not conf.get(PROVIDER, None):
        conf.set(PROVIDER, ROCKSDB)  # the only one that keeps timers
    return runs.withWatermark("run", delay).groupBy("flow_id").transformWithStateInPandas(Retirement(needed, keep_ms), "flow_id long, run timestamp", "append", "eventTime")
