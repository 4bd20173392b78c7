"""Block exchange: the way in which documents ask a distributed index about what they contain.

Documents are dealt to blocks of bounded text size by a hash of their row number, so that neither rows with one id (or
none) nor copies of one text gather in a block. Each block sends its *distinct* keys, packed, to hash buckets: a key that
a third of all documents share reaches its bucket once a block. The bucket answers each block with one payload in the same
key order, and the block finishes its documents with all answers at hand. Only packed arrays are shuffled, never a row for
each occurrence. A bucket serves ``BLOCKS_A_BUCKET`` blocks' worth of keys, and a bucket for which a block has no key gets
no payload; with more than ``DIRECT`` blocks the payloads travel in bundles through districts of about the square root of
their number (see ``route``), so that rows shuffled grow with the power 1.5 of the corpus and not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.tables import materialize

BLOCK_BYTES, LEAST_BYTES = 12 << 20, 1 << 20
BLOCKS_A_BUCKET, FEWEST, DIRECT = 8, 16, 2048
PAYLOAD = "block int, bucket int, payload binary"
BUNDLE = "district int, column int, block array<int>, bucket array<int>, payload array<binary>"
_PAYLOAD = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about block_bytes of text (a sum over all rows), and no fewer than tasks while they are not tiny."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long") + 64).alias("b")).first()["b"] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(total / block_bytes), min(tasks, math.ceil(total / LEAST_BYTES)))


def bucket_count(n: int) -> int:
    """Buckets for n blocks."""
    return max(min(FEWEST, n), -(-n // BLOCKS_A_BUCKET))


def settled(docs: DataFrame) -> DataFrame:
    """docs, written first unless its rows come in the same order whenever a task reads them again, as those of a scan do."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return materialize(docs, "documents") if "Exchange" in plan or "AdaptiveSparkPlan" in plan else docs


def with_block(docs: DataFrame, n: int, rest: tuple[str, ...] | None = None) -> DataFrame:
    """block, doc_id and text; with rest, the named columns as one column ``rest``. For use in one job: another job may
    deal the rows differently."""
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("block")
    docs = settled(docs)
    if rest is None:
        return docs.select(block, "doc_id", "text")
    return docs.select(block, "doc_id", "text", (F.struct(*rest) if rest else F.lit(0)).alias("rest"))


def schema_with_rest(ddl: str, blocks: DataFrame) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(ddl).fields, T.StructField("rest", blocks.schema["rest"].dataType)])


def with_rest(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns of ``rest`` in its place."""
    return df.select(*(c for c in df.columns if c != "rest"), *(F.col(f"rest.`{c}`").alias(c) for c in keep))


def give_back() -> None:
    """Return freed memory to the system: a worker lives on, and its allocators keep the peak of each group otherwise."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def released(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """work, which gives its memory back behind each group."""

    def run(*tables: pa.Table) -> pa.Table:
        out = work(*tables)
        give_back()
        return out

    # Spark tells the form of a function by its parameters
    return (lambda table: run(table)) if work.__code__.co_argcount == 1 else (lambda table, answers: run(table, answers))


def payload_table(block: int, buckets: Iterable[tuple[int, bytes]]) -> pa.Table:
    """PAYLOAD rows of a block; empty payloads have none."""
    rows = [(k, p) for k, p in buckets if p]
    return pa.table(
        [pa.array([block] * len(rows), pa.int32()), pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())],
        schema=_PAYLOAD,
    )


def answers_table(table: pa.Table, payloads: list[bytes]) -> pa.Table:
    return pa.table([table["block"], table["bucket"], pa.array(payloads, pa.binary())], schema=_PAYLOAD)


def payloads(table: pa.Table) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in table["payload"]]


def by_bucket(table: pa.Table) -> dict[int, bytes]:
    """Payloads of a block's answers by bucket."""
    return dict(zip(table["bucket"].to_pylist(), payloads(table)))


def bucket_offsets(bucket_of: np.ndarray, n: int) -> np.ndarray:
    """Where each of the n buckets begins, and the last ends, in keys sorted by bucket."""
    return np.searchsorted(bucket_of, np.arange(n + 1))


def _bundles(table: pa.Table, side: int) -> pa.Table:
    """The rows of PAYLOAD as one row for each district of blocks and column of buckets."""
    found: dict[tuple[int, int], tuple[list, list, list]] = {}
    for block, bucket, payload in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), payloads(table)):
        for column, value in zip(found.setdefault((block // side, bucket // side), ([], [], [])), (block, bucket, payload)):
            column.append(value)
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()))
    columns = zip(*((d, c, *lists) for (d, c), lists in found.items())) if found else ([],) * 5
    return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)], names=["district", "column", "block", "bucket", "payload"])


def _unbundled(table: pa.Table) -> pa.Table:
    parts = [pa.compute.list_flatten(table[c].combine_chunks()) for c in ("block", "bucket", "payload")]
    return pa.table(parts, names=["block", "bucket", "payload"]).cast(_PAYLOAD)


def _dealt(name: str):
    def deal(table: pa.Table) -> pa.Table:
        """The payloads of a district and column that go to one bucket, or return to one block, in one row each."""
        flat = _unbundled(table)
        out = [(flat.filter(pa.compute.equal(flat[name], k))) for k in pa.compute.unique(flat[name])]
        head = [pa.array([t[name][0].as_py() for t in out], pa.int32())]
        return pa.table(head + [pa.array([t[c].to_pylist() for t in out], pa.list_(_PAYLOAD.field(c).type)) for c in ("block", "bucket", "payload")], names=["to", "block", "bucket", "payload"])

    return deal


def route(asked: DataFrame, answer: Callable[[pa.Table], pa.Table], n: int) -> DataFrame:
    """Answers to PAYLOAD rows of n blocks, through districts: bundles of payloads go from each block to the columns of
    its district, from there to the buckets, and the same way back. ``asked`` has a row BUNDLE for each block and column."""
    to = "to int, block array<int>, bucket array<int>, payload array<binary>"
    side = district_side(n)
    forth = asked.groupBy("district", "column").applyInArrow(_dealt("bucket"), to)
    answered = forth.groupBy("to").applyInArrow(lambda t: _bundles(answer(_unbundled(t)), side), BUNDLE)
    back = answered.groupBy("district", "column").applyInArrow(_dealt("block"), to)
    return back.select(F.col("to").alias("block"), F.explode(F.arrays_zip("bucket", "payload")).alias("x")).select("block", "x.bucket", "x.payload")


def district_side(n: int) -> int:
    return max(1, math.isqrt(max(n - 1, 0)) + 1)


def answered(asked: DataFrame, answer: Callable[[pa.Table], pa.Table], n: int) -> DataFrame:
    """PAYLOAD rows that answer those of n blocks."""
    if n <= DIRECT:
        return asked.groupBy("bucket").applyInArrow(released(answer), PAYLOAD)
    side = district_side(n)
    bundled = asked.mapInArrow(lambda batches: (b for t in batches for b in _bundles(pa.Table.from_batches([t]), side).to_batches()), BUNDLE)
    return route(bundled, answer, n)


def exchange(
    blocks: DataFrame,
    ask: Callable[[pa.Table], pa.Table],
    answer: Callable[[pa.Table], pa.Table],
    finish: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    n: int,
) -> DataFrame:
    """blocks has a column ``block`` of n values; ask and answer return PAYLOAD rows, finish gets a block and its answers."""
    asked = blocks.groupBy("block").applyInArrow(released(ask), PAYLOAD)
    return blocks.groupBy("block").cogroup(answered(asked, answer, n).groupBy("block")).applyInArrow(released(finish), schema)
