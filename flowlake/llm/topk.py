"""Exact top-k inner-product search by a three-phase uniform threshold.

The components of the vectors are dealt to ``SLICES`` vertical slices, as a score is the sum of its slices' local
scores. (1) Every slice gathers, in tiles of rows and queries, its local top k for each query; the exact scores of
these entries give a safe cutoff, the k-th best so far. A tile holds at most about ``ROWS`` rows and ``QUERIES`` queries and
scores ``CHUNK`` of these at a time, so rows are sent once for every 4096 queries and queries once for every 8192 rows. (2) An entry whose total reaches the cutoff has a local
score of at least cutoff / SLICES somewhere: each query carries its cutoff to the tiles, which collect those entries
(and, exact as well, leave out those that the norms of the other slices keep below the cutoff). (3) Entries whose
upper bound reaches the cutoff and that lack a slice are resolved exactly.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows without vec_id, take no
part; scores that could pass a long are an error; queries are compared with vectors of their own length; rows with one vec_id are candidates each on its own
but for the query of that vec_id, and as queries too: the pairs of all of them are ranked together; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.embedding_dedup import usable
from flowlake.tables import materialize

K, SLICES, ROWS, QUERIES, CHUNK = 10, 2, 8192, 4096, 256
_LOCAL = "query_id long, query_row long, row long, vec_id long, local long"


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = values.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every sum stays below 2**53, else in longs; ArithmeticError where a
    sum could pass these too."""
    most = int(np.abs(q.astype(np.float64)).max()) * int(np.abs(x.astype(np.float64)).max()) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 63:
        raise ArithmeticError("scores beyond a long")
    return q @ x.T


def _local(first: bool, k: int, slices: int):
    def tile(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {c: [] for c in ("query_id", "query_row", "row", "vec_id", "local")}
        if len(queries) and len(rows):
            q, x = _matrix(queries["part"]), _matrix(rows["part"])
            scores = (own for i in range(0, len(q), CHUNK) for own in _scores(q[i : i + CHUNK], x))
            ids, at, rest = rows["vec_id"].to_numpy(), rows["row"].to_numpy(), rows["rest"].to_numpy()
            cutoffs = [None] * len(queries) if first else queries["cutoff"].to_pylist()
            for own, query, asking, cutoff, mine in zip(scores, queries["query_id"].to_numpy(), queries["query_row"].to_numpy(), cutoffs, queries["rest"].to_numpy()):
                others = np.flatnonzero(ids != query)
                if first:
                    if len(others) > k:
                        others = others[np.argpartition(-own[others], k - 1)[:k]]
                elif cutoff is not None:
                    local = own[others]
                    others = others[(local * slices >= cutoff) & (local + mine * rest[others] * (1 + 1e-9) + 1 >= cutoff)]
                for name, values in (("query_id", np.full(len(others), query)), ("query_row", np.full(len(others), asking)), ("row", at[others]), ("vec_id", ids[others]), ("local", own[others])):
                    out[name].append(values)
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for c, v in out.items()})

    return tile


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def top_k(vectors: DataFrame, is_query, k: int = K, slices: int = SLICES) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of the integer vectors ``v`` for every row for which is_query holds."""
    rows = materialize(vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("row"), F.size("v").alias("dim")), "vectors")
    n = rows.count()
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), "v", "dim")
    shards, groups = max(1, -(-n // ROWS)), max(1, -(-queries.count() // QUERIES))

    def sliced(df: DataFrame, *columns: str) -> DataFrame:
        width = F.ceil(F.col("dim") / slices).cast("int")
        df = df.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        part = F.slice("v", F.col("slice") * width + 1, width)
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x) - F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        return df.select(*columns, "dim", "slice", part.alias("part"), F.sqrt(F.greatest(norm, F.lit(0.0))).alias("rest"))

    def everywhere(df: DataFrame, name: str, count: int) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))

    key = ["dim", "slice", "shard", "deal"]
    dealt = everywhere(sliced(rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "vec_id", "row", "shard"), "deal", groups)

    def scan(asking: DataFrame, columns: list[str], first: bool) -> DataFrame:
        asking = asking.withColumn("deal", F.pmod(F.xxhash64("query_row"), F.lit(groups)).cast("int"))
        tiles = everywhere(sliced(asking, *columns, "deal"), "shard", shards)
        return tiles.groupBy(key).cogroup(dealt.groupBy(key)).applyInArrow(_local(first, k, slices), _LOCAL)

    def exact(pairs: DataFrame) -> DataFrame:
        """The scores of distinct pairs of query_row and row."""
        own = queries.select("query_row", F.col("v").alias("q"))
        return pairs.join(rows.select("row", "v"), "row").join(own, "query_row").select("query_id", "query_row", "row", "vec_id", _dot("q", "v").alias("score"))

    # 1: local lists, and from their exact scores the cutoff
    some = scan(queries, ["query_id", "query_row"], True).select("query_id", "query_row", "row", "vec_id").distinct()
    order = [F.desc("score"), F.col("vec_id"), F.col("row"), F.col("query_row")]
    best = Window.partitionBy("query_row").orderBy(*order)
    cutoffs = exact(some).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_row", F.col("score").alias("cutoff"))
    asking = materialize(queries.join(cutoffs, "query_row", "left"), "queries")
    # 2: all entries that may reach it
    entries = scan(asking, ["query_id", "query_row", "cutoff"], False)
    sums = entries.groupBy("query_id", "query_row", "row", "vec_id").agg(F.sum("local").alias("score"), F.count("*").alias("parts"))
    sums = sums.join(asking.select("query_row", "cutoff"), "query_row")
    left_out = F.lit(slices) - F.col("parts")
    sums = sums.where(F.col("cutoff").isNull() | (slices * F.col("score") + left_out * F.col("cutoff") >= slices * F.col("cutoff")))
    sums = materialize(sums, "entries")
    # 3: the rest of their scores
    full = sums.where(left_out == 0).select("query_id", "query_row", "row", "vec_id", "score")
    full = full.unionByName(exact(sums.where(left_out > 0).select("query_id", "query_row", "row", "vec_id")))
    out = full.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, the components times scale rounded down, of the rows that take part."""
    good = usable("embedding") & F.col("vec_id").isNotNull()
    return vectors.where(good).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def op5_topk(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
