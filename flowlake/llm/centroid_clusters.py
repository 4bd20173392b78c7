"""Centroid clustering of integer vectors, with Ptolemaic pivots.

The starting centroids stay on as pivots. Every vector's distances to the pivots are computed once and stored beside it. In
each round Ptolemy's inequality over fixed pairs of pivots (p, q) bounds the distance of a vector x to a centroid c from below,
``|d(x,p) d(c,q) - d(x,q) d(c,p)| / d(p,q)``, from stored distances alone; the bounds are rounded down by more than floating point
can have added. The centroid with the smallest bound is measured first, exactly, and then only those whose bound doesn't exceed
the best distance found. Distances and sums are exact integers; the bounds only decide what need not be measured.

A round is one pass over the stored vectors: a task returns one row of counts and sums for each centroid, which Spark adds up,
and the driver gets as many rows as there are centroids. No vector is shuffled.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out; rows with one
vec_id are vectors each, in order of their components where the starting order needs one; rows without vec_id are clustered, and
start a centroid only where others don't suffice; with fewer vectors than centroids each starts one; of equal centroids the smaller
number takes all; an empty table gives none; other columns are ignored. A component beyond LIMIT in size raises ValueError, as
the distances would exceed a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.tables import materialize

DIM, CLUSTERS, ROUNDS, SCALE, SEED, LIMIT, ROWS = 64, 8, 10, 1024, 3, 1 << 27, 2048
_SLACK = 2.0**-47  # of the terms of a bound; products, quotients and stored roots err by less than a tenth of it together


def usable(dim: int) -> F.Column:
    """Vectors of dim components, all finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (F.size("embedding") == dim) & F.forall("embedding", finite)


def to_integers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) of every component."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = np.floor(x * SCALE)
    if len(x) and np.abs(x).max() > LIMIT:
        raise ValueError(f"a component exceeds {LIMIT / SCALE}")
    return x.astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """Lower bounds of distances to centroids from distances to pivots."""

    def __init__(self, pivots: np.ndarray, centroids: np.ndarray):
        n = len(pivots)
        to = np.sqrt(np.array([squared(centroids, p) for p in pivots], np.float64))  # by pivot and centroid
        self.pairs, self.left, self.right = [], [], []
        for a, b in sorted({tuple(sorted((a, (a + k) % n))) for a in range(n) for k in (1, n // 2) if a != (a + k) % n}):
            if apart := float(np.sqrt(squared(pivots[a : a + 1], pivots[b])[0])):
                self.pairs.append((a, b))
                self.left.append(to[b] / apart)
                self.right.append(to[a] / apart)
        self.n = len(centroids)
        self.most = max((float((x + y).max()) for x, y in zip(self.left, self.right)), default=0.0)

    def below(self, distances: np.ndarray) -> np.ndarray:
        """By vector and centroid."""
        out = np.zeros((len(distances), self.n))
        for (a, b), left, right in zip(self.pairs, self.left, self.right):
            np.maximum(out, np.abs(distances[:, a, None] * left - distances[:, b, None] * right), out=out)
        return np.maximum(out - _SLACK * self.most * distances.max(axis=1, keepdims=True, initial=0), 0) * (1 - _SLACK)


def nearest(x: np.ndarray, distances: np.ndarray, centroids: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the smaller number of several) and squared distance of each vector, and how many distances were measured."""
    low = bounds.below(distances)
    best = low.argmin(axis=1)
    found = squared(x, centroids[best])
    first, root, measured = best.copy(), np.sqrt(found) * (1 + _SLACK), len(x)
    for c in range(len(centroids)):
        rows = np.flatnonzero((low[:, c] <= root) & (first != c))
        own = squared(x[rows], centroids[c])
        measured += len(rows)
        better = (own < found[rows]) | (own == found[rows]) & (c < best[rows])
        at = rows[better]
        best[at], found[at] = c, own[better]
        root[at] = np.sqrt(found[at]) * (1 + _SLACK)
    return best, found, measured


def _stored(vectors: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """vec_id, components and distances to the pivots."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = to_integers(batch["embedding"], dim)
            away = np.sqrt(np.stack([squared(x, p) for p in pivots], axis=1).astype(np.float64))
            parts = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x.astype("<i4"), away.astype("<f8"))]
            yield pa.record_batch([batch["vec_id"], *parts], names=["vec_id", "x", "away"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, x binary, away binary")


def _parts(batches: Iterable[pa.RecordBatch], dim: int, n_pivots: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    flat = lambda column, kind, n: np.frombuffer(b"".join(v.as_buffer() for v in column), kind).reshape(-1, n)
    for batch in batches:
        for lo in range(0, len(batch), ROWS):
            part = batch.slice(lo, ROWS)
            yield part["vec_id"], flat(part["x"], "<i4", dim).astype(np.int64), flat(part["away"], "<f8", n_pivots)


def cluster_sums(stored: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """For every non-empty cluster its number, size n, componentwise sums s0, s1, ... and how many distances were measured."""
    dim, k = centroids.shape[1], len(centroids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, total = Bounds(pivots, centroids), np.zeros((k, dim + 2), np.int64)
        for _, x, away in _parts(batches, dim, len(pivots)):
            best, _, measured = nearest(x, away, centroids, bounds)
            total[0, -1] += measured
            for c in range(k):
                own = best == c
                total[c, 0] += own.sum()
                total[c, 1:-1] += x[own].sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(k, dtype=np.int32)), *(pa.array(v) for v in total.T)], names=names)

    names = ["cluster", "n", *(f"s{i}" for i in range(dim)), "measured"]
    each = stored.mapInArrow(run, ", ".join(f"{c} {'int' if c == 'cluster' else 'long'}" for c in names))
    return each.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in names[1:]))


def moved(centroids: np.ndarray, rows: list) -> np.ndarray:
    """Centroids after a round: floors of the means of non-empty clusters."""
    out = centroids.copy()
    for row in rows:
        if row["n"]:
            out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared, to the cluster's centroid), cluster_inertia, inertia and centroid_sha256."""
    spark = vectors.sparkSession
    kept = vectors.where(usable(dim)).select("vec_id", "embedding")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "embedding").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    pivots = to_integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), dim)
    stored = materialize(_stored(kept, pivots, dim), "vectors")
    centroids = pivots
    for _ in range(rounds):
        was, centroids = centroids, moved(centroids, cluster_sums(stored, pivots, centroids).collect())
        if np.array_equal(was, centroids):
            break  # no later round would move one

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(pivots, centroids)
        for vec_id, x, away in _parts(batches, dim, len(pivots)):
            best, found, _ = nearest(x, away, centroids, bounds)
            yield pa.record_batch([vec_id, pa.array(best.astype(np.int32)), pa.array(found)], names=["vec_id", "cluster", "distance"])

    assigned = materialize(stored.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    facts = [(c, s, sum(sums.values()), digest(c)) for c, s in sums.items()]  # a row a centroid
    return assigned.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    parts = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, embedding) - 1 AS c, v FROM kept QUALIFY c < {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT r, v, vec_id, c, d FROM (SELECT k.r, k.v, k.vec_id, c.c, list_sum(list_transform(range(1, {DIM + 1}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS d FROM kept k, c{i} c)
              QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        )
        if i < ROUNDS:
            parts.append(f"s{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({DIM})) AS i FROM a{i}) GROUP BY c, i)")
            parts.append(f"m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m ON o.c = m.c)")
    return (
        f"WITH {', '.join(parts)} SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.c = c.c"
    )


ORACLE = _oracle()
