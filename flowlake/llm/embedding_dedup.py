"""Embedding near-dedup with randomised-rotation binary codes.

Equal vectors of one label become one class. A class's unit vector is turned by a fixed random rotation and stored once as its
code: the signs of the turned components, the inner product of the vector with them (the correction factor), and the turned
components rounded to bytes, with their step. Bands of ``WIDTH`` bits, of the signs under as many rotations as the bands need,
bring candidates together within a label; the bands are the same at every size of the table.

Tiles of codes compare candidates first: a pair's code and factor on one side and the rounded components on the other give an
unbiased estimate of its inner product, with a confidence bound that takes in the rounding. Only rows with a pair whose bound
reaches the threshold get their vectors; they meet again in their tile, and the pairs within the bound are recomputed there, in
double precision. A pair counts in the first band on which its codes agree. Groups above the tile size are compared
in pairs of tiles, so no partner is left out; a tile returns sums of links and roots of its rows, never pairs.

Recall against brute force is measured in the tests (at least 0.9 is asked; links found are always exact). Defined
results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or
vec_id, link with nothing; vectors of different length or label don't link; rows with one vec_id each have the links of their
own vector, and share a component; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.components import connected_components
from flowlake.tables import materialize

THRESHOLD, BANDS, WIDTH, TILE, CONFIDENCE, SEED = 0.98, 16, 16, 512, 4.0, 11
_CODE = "cls long, label {label}, dim int, size long, code binary, factor double, rounded binary, step double, keys array<int>"
_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th fixed random orthonormal matrix of a dimension."""
    if (dim, k) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).standard_normal((dim, dim)))
        _rotations[dim, k] = q * np.sign(np.diag(r))
    return _rotations[dim, k]


def band_keys(unit: np.ndarray, bands: int, width: int) -> np.ndarray:
    """For each unit vector the code bits of each band, packed into an integer."""
    dim, bits = unit.shape[1], []
    for k in range(-(-bands * width // dim)):
        bits.append(unit @ rotation(dim, k) > 0)
    code = np.concatenate(bits, axis=1)[:, : bands * width].reshape(len(unit), bands, width)
    return (code << np.arange(width)).sum(axis=2).astype(np.int32)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signs, correction factors, rounded components and their steps of unit vectors."""
    turned = unit @ rotation(unit.shape[1], 0)
    factor = np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])
    step = np.abs(turned).max(axis=1) / 127
    return turned > 0, factor, np.rint(turned / step[:, None]).astype(np.int8), step


def estimate(code: np.ndarray, factor: np.ndarray, turned: np.ndarray, step: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded unit vectors (signs +1 and -1) with turned ones that are rounded to
    multiples of step, and their bounds."""
    dim = code.shape[1]
    guess = (code @ turned.T) / (math.sqrt(dim) * factor[:, None])
    spread = CONFIDENCE * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(dim - 1, 1))
    return guess, spread[:, None] + np.asarray(step) / 2 * math.sqrt(dim) / factor[:, None]


def _codes(batches):
    for batch in batches:
        sizes, columns = batch["dim"].to_numpy(), [None] * len(batch)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            x = _matrix(batch["embedding"].take(pa.array(at)))
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            signs, factor, rounded, step = encode(unit)
            keys, bits = band_keys(unit, BANDS, WIDTH), np.packbits(signs, axis=1)
            for i, row in enumerate(at):
                columns[row] = (bits[i].tobytes(), factor[i], rounded[i].tobytes(), step[i], keys[i])
        kinds = (pa.binary(), pa.float64(), pa.binary(), pa.float64(), pa.list_(pa.int32()))
        own = [pa.array(c, k) for c, k in zip(zip(*columns), kinds)] if columns else [pa.array([], k) for k in kinds]
        names = ["cls", "label", "dim", "size"]
        yield pa.record_batch([*(batch[c] for c in names), *own], names=[*names, "code", "factor", "rounded", "step", "keys"])


class _Codes:
    """The codes of a tile, and for each row the partners that estimates leave."""

    def __init__(self, table: pa.Table, key: tuple, threshold: float):
        band, self.low, self.high = (k.as_py() for k in key[3:6])
        flat = lambda c, kind: np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in table[c]), kind).reshape(len(table), -1)
        dim = table["dim"][0].as_py()
        self.code = np.unpackbits(flat("code", np.uint8), axis=1, count=dim).astype(np.float32) * 2 - 1
        self.factor, self.step = table["factor"].to_numpy(), table["step"].to_numpy()
        self.turned = (flat("rounded", np.int8) * self.step[:, None]).astype(np.float32)
        self.part, self.ids, self.threshold = table["part"].to_numpy(), table["cls"].to_numpy(), threshold
        self.keys = np.stack(table["keys"].to_numpy())[:, :band] if band else None

    def near(self):
        for i in np.flatnonzero(self.part == self.low):
            others = np.flatnonzero((self.part == self.high) & (self.ids > self.ids[i] if self.low == self.high else True))
            if not len(others):
                continue
            guess, spread = estimate(self.code[i : i + 1], self.factor[i : i + 1], self.turned[others], self.step[others])
            near = others[(guess + spread)[0] + 1e-5 >= self.threshold]
            if self.keys is not None and len(near):
                near = near[~(self.keys[near] == self.keys[i]).any(axis=1)]
            if len(near):
                yield i, near


def _sift(threshold: float):
    def sift(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The rows of a tile with a partner whose bound reaches the threshold."""
        some = np.zeros(len(table), bool)
        for i, near in _Codes(table, key, threshold).near():
            some[i] = some[near] = True
        return table.filter(pa.array(some))

    return sift


def _tile(threshold: float):
    def tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Weights of the links found here for each class, and its root among them."""
        codes, x, size = _Codes(table, key, threshold), _matrix(table["embedding"]), table["size"].to_numpy()
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))
        root, links = np.arange(len(x)), np.zeros(len(x), np.int64)
        for i, near in codes.near():
            near = near[(x[near] @ x[i]) / (norms[near] * norms[i]) >= threshold]
            links[i] += size[near].sum()
            links[near] += size[i]
            for j in near[root[near] != root[i]]:
                root[root == root[j]] = root[i]
        some = np.flatnonzero(links)
        return pa.table({"cls": pa.array(codes.ids[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(codes.ids[root[some]], pa.int64())})

    return tile


def usable(vector: str):
    """Whether a vector column is present, not empty and holds only finite components."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vec_id, embedding and label."""
    rows = vectors.select("vec_id", "label", "embedding")
    good = usable("embedding") & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    same = ["label", "embedding"]
    classes = rows.where(good).groupBy(*same).agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = materialize(classes.select("*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("cls")), "vectors")
    schema = _CODE.format(label=classes.schema["label"].dataType.simpleString())
    codes = materialize(classes.mapInArrow(_codes, schema), "codes")
    held = codes.select("cls", "label", "dim", F.posexplode("keys").alias("band", "key"))
    group = ["label", "dim", "key", "band"]
    parts = held.groupBy(group).agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = held.join(parts, group).withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("cls", *group, "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    tiles = dealt.join(codes.drop("label", "dim"), "cls")
    sifted = materialize(tiles.groupBy(*group, "low", "high").applyInArrow(_sift(threshold), tiles.schema), "tiles")
    found = sifted.join(classes.select("cls", "embedding"), "cls").groupBy(*group, "low", "high")
    found = materialize(found.applyInArrow(_tile(threshold), "cls long, links long, root long"), "links")
    known = rows.where(good).join(classes, same).select("vec_id", "cls")
    several = known.groupBy("vec_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b").select("vec_id", "a")
    one_id = known.join(several, "vec_id").where("cls > a").select(F.col("cls").alias("node"), F.col("a").alias("to"))
    edges = found.select(F.col("cls").alias("node"), F.col("root").alias("to")).unionByName(one_id)
    roots = connected_components(edges, "node", "to").select(F.col("node").alias("cls"), "component")
    weight = found.groupBy("cls").agg(F.sum("links").alias("links"))
    of_class = classes.select("cls", *same, "least", "size").join(weight, "cls", "left").join(roots, "cls", "left")
    of_class = of_class.withColumn("component", F.coalesce("component", "cls"))
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(least, "component").select(*same, (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    mine = rows.where(good).join(of_class, same).select("vec_id", "n_links", "component_id")
    rest = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return mine.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS row, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.row AS a, b.row AS b, a.vec_id AS a_id, b.vec_id AS b_id FROM good a JOIN good b ON a.label = b.label AND a.row <> b.row AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98),
counts AS (SELECT a AS row, count(*) AS n FROM links GROUP BY a),
reached AS (SELECT DISTINCT a_id AS id, b_id AS other FROM links UNION SELECT r.id, l.b_id FROM reached r JOIN links l ON r.other = l.a_id),
least AS (SELECT id, min(other) AS component FROM reached GROUP BY id)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, CAST(least(e.vec_id, coalesce(m.component, e.vec_id)) AS BIGINT) AS component_id, e.vec_id <= coalesce(m.component, e.vec_id) AS kept
FROM (SELECT vec_id FROM embeddings) e LEFT JOIN good g USING (vec_id) LEFT JOIN counts c USING (row) LEFT JOIN least m ON m.id = e.vec_id
"""
