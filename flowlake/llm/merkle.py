"""A Merkle manifest of a dataset: digests of rows, trees over each source and over the sources, proofs and their check.

Every node is labelled with the interval [lo, hi) of the ranks of the leaves that it covers, so a node is an ancestor of another
when its interval contains the other's, and its siblings are the nodes of its level that cover what its parent's interval has
beside its own. Levels are taken in bands of BAND: the nodes of a band that lie in one interval of 3**BAND nodes are one packed
row, found by the rank divided by the width. Going up, each packed row gives the node above it; going down, a row joins the one node
of the band above whose interval contains its own and takes over what that node knows: the siblings of all its
ancestors. So leaves are shuffled twice (for their ranks and into packed rows) whatever the height of the trees.

``H`` is the lowercase hex SHA-256 of its inputs in a row. Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

Defined results: null values have a mark of their own, so a null text differs from an empty one; rows without doc_id come first in
their source and are never tampered with; rows with one doc_id are leaves each, in order of their digests; equal rows have equal
leaves and proofs of their own places; rows without source are a source; texts of any length are hashed where they are read and never
shuffled; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm.ranks import ranked
from flowlake.tables import materialize

ARITY, BAND = 3, 5
_OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field(value: F.Column) -> F.Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: F.Column) -> F.Column:
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, the leaf digest, and that of the tampered row where it is another."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.when(even & F.col("text").contains("\n"), F.unhex(leaf_digest(F.replace(F.col("text"), F.lit("\n"), F.lit("")))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.unhex(leaf_digest(F.col("text"))).alias("leaf"), cut.alias("tampered"))


class Node:
    """A node of a tree: its interval of leaf ranks and its digest."""

    __slots__ = ("lo", "hi", "digest")

    def __init__(self, lo: int, hi: int, value: bytes):
        self.lo, self.hi, self.digest = lo, hi, value

    def covers(self, other: Node) -> bool:
        return self.lo <= other.lo and other.hi <= self.hi


def levels(nodes: list[Node], in_tree: int, height: int) -> list[list[Node]]:
    """The nodes of a packed row and of the levels above them in their band; in_tree: nodes that the whole tree has on their level."""
    out = [nodes]
    while in_tree > 1 and len(out) <= height:
        below = out[-1]
        runs = [below[i : i + ARITY] for i in range(0, len(below), ARITY)]
        out.append([Node(r[0].lo, r[-1].hi, digest(x.digest for x in r)) for r in runs])
        in_tree = -(-in_tree // ARITY)
    return out


def proofs(band: list[list[Node]], above: bytes) -> list[bytes]:
    """For each node of the lowest level the siblings of itself and its ancestors in the band, from below, and then ``above``."""
    know = [above] * len(band[-1])
    for level in range(len(band) - 2, -1, -1):
        nodes, parents, tail = band[level], band[level + 1], know
        know, at = [], 0
        for node in nodes:
            while not parents[at].covers(node):
                at += 1
            beside = nodes[at * ARITY : (at + 1) * ARITY]  # what the parent's interval holds; without the node's own interval these are its siblings
            know.append(b"".join(x.digest for x in beside if x.hi <= node.lo or node.hi <= x.lo) + tail[at])
    return know


def fold(leaf: bytes, proof: bytes, places: Iterable[tuple[int, int]]) -> bytes:
    """The root that a leaf and its proof give; places: its rank and the number of leaves, tree by tree."""
    at = 0
    for rank, count in places:
        while count > 1:
            left = rank % ARITY
            right = min(ARITY, count - (rank - left)) - left - 1
            mid, end = at + 64 * left, at + 64 * (left + right)
            leaf = digest((proof[at:mid], leaf, proof[mid:end]))
            at, rank, count = end, rank // ARITY, -(-count // ARITY)
    return leaf


def packed(nodes: DataFrame, width: int, *more: str) -> DataFrame:
    """The nodes (tree, n, lo, hi, digest) that lie in an interval of width as one row, with its interval."""
    items = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest", *more))).alias("items")
    return nodes.groupBy("tree", "n", F.floor(F.col("lo") / width).alias("place")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), items)


def _nodes(items: list[dict]) -> list[Node]:
    return [Node(x["lo"], x["hi"], x["digest"].hex().encode()) for x in items]


def _grown(row: dict, band: int, height: int) -> list[list[Node]]:
    return levels(_nodes(row["items"]), -(-row["n"] // ARITY ** (height * band)), height)


class Forest:
    """The bands of trees whose leaves are (tree, n, lo, hi, digest), from below."""

    def __init__(self, base: DataFrame, height: int, *more: str):
        self.height = height
        self.bands: list[DataFrame] = []
        most = base.agg(F.max("n").alias("m")).first()["m"] or 0
        nodes, band = base, 0
        while True:
            self.bands.append(materialize(packed(nodes, self.width(band), *(more if not band else ())), f"band{band}"))
            nodes = self._tops(band)
            if most <= self.width(band):
                break
            band += 1
        self.roots = nodes  # one node a tree

    def width(self, band: int) -> int:
        """Leaves below a packed row of a band."""
        return ARITY ** (self.height * (band + 1))

    def _tops(self, band: int) -> DataFrame:
        height = self.height

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                top = [_grown(r, band, height)[-1][0] for r in rows]
                columns = [batch["tree"], batch["n"], pa.array([x.lo for x in top], pa.int64()), pa.array([x.hi for x in top], pa.int64()), pa.array([bytes.fromhex(x.digest.decode()) for x in top], pa.binary())]
                yield pa.record_batch(columns, names=["tree", "n", "lo", "hi", "digest"])

        return self.bands[band].select("tree", "n", "items").mapInArrow(run, "tree long, n long, lo long, hi long, digest binary")

    def known(self, above: DataFrame, band: int) -> DataFrame:
        """Packed rows of a band with what the node that contains them knows: ``above`` has tree, lo, hi and proof."""
        width = self.width(band)
        up = above.select(F.col("tree").alias("_tree"), F.floor(F.col("lo") / width).alias("_place"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "proof")
        inside = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
        return self.bands[band].join(up, (F.col("tree") == F.col("_tree")) & (F.col("place") == F.col("_place")) & inside)

    def handed_down(self, above: DataFrame, down_to: int) -> DataFrame:
        """What the nodes of band down_to - 1's tops know: tree, lo, hi, proof; above: that of the roots."""
        height = self.height

        def step(band: int):
            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    rows = []
                    for r in batch.to_pylist():
                        grown = _grown(r, band, height)
                        rows += [(r["tree"], x.lo, x.hi, p) for x, p in zip(grown[0], proofs(grown, r["proof"]))]
                    columns = zip(*rows) if rows else [[]] * 4
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["tree", "lo", "hi", "proof"])

            return run

        for band in range(len(self.bands) - 1, down_to - 1, -1):
            above = self.known(above, band).select("tree", "n", "items", "proof").mapInArrow(step(band), "tree long, lo long, hi long, proof binary")
        return above


def manifest(docs: DataFrame, height: int = BAND) -> DataFrame:
    """One row a document; see the module. height: levels of a band."""
    spark = docs.sparkSession
    own = materialize(leaves(docs).withColumn("row", F.monotonically_increasing_id()), "leaves")
    sources = materialize(ranked(own.groupBy("source").agg(F.count("*").alias("n")), [], ["source"]).withColumnRenamed("rank", "tree"), "sources")
    n_sources = sources.count()
    if not n_sources:
        return spark.createDataFrame([], _OUT)
    placed = ranked(own, ["source"], ["doc_id", "leaf", "row"]).alias("a").join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    base = placed.select("b.tree", "b.n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"), "doc_id", "tampered")
    trees = Forest(base, height, "doc_id", "tampered")
    subroots = materialize(trees.roots, "subroots")
    top = Forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_sources).cast("long").alias("n"), F.col("tree").alias("lo"), (F.col("tree") + 1).alias("hi"), "digest"), height)
    root = top.roots.first()["digest"].hex()
    nothing = spark.createDataFrame([(0, 0, n_sources, b"")], "tree long, lo long, hi long, proof binary")
    over = top.handed_down(nothing, 0).select(F.col("lo").alias("tree"), "proof")
    over = materialize(subroots.join(over, "tree").select("tree", "lo", "hi", "digest", "proof"), "over")
    above = trees.handed_down(over.select("tree", "lo", "hi", "proof"), 1)
    facts = over.select(F.col("tree").alias("_source"), F.col("digest").alias("subroot"))
    rows = trees.known(above, 0).join(facts, F.col("tree") == F.col("_source")).select("tree", "n", "items", "proof", "subroot")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                grown, out = _grown(r, 0, height), []
                for item, node, proof in zip(r["items"], grown[0], proofs(grown, r["proof"])):
                    start = item["tampered"].hex().encode() if item["tampered"] else node.digest
                    folded = fold(start, proof, ((item["lo"], r["n"]), (r["tree"], n_sources))).decode()
                    out.append((item["doc_id"], node.digest.decode(), r["subroot"].hex(), root, digest([proof]).decode(), folded, folded == root))
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in _OUT.split(", ")])

    return rows.mapInArrow(run, _OUT)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"
_CRC = "list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, _z: xor(s >> 1, 3988292384 * (s & 1))))"
ORACLE = f"""
WITH RECURSIVE leaf AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_LEAF.format(_FIELD.format("text"))} AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN {_LEAF.format(_FIELD.format("replace(text, chr(10), '')"))} ELSE {_LEAF.format(_FIELD.format("text"))} END AS given
  FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaf),
up AS (SELECT tree, 0 AS level, rank AS idx, n AS m, leaf AS digest FROM ranked
  UNION ALL SELECT tree, level + 1, idx // {ARITY}, (m + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE m > 1 GROUP BY tree, level, m, idx // {ARITY}),
sub AS (SELECT tree, digest FROM up WHERE m = 1),
top AS (SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM sub) AS m, digest FROM sub
  UNION ALL SELECT level + 1, idx // {ARITY}, (m + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE m > 1 GROUP BY level, m, idx // {ARITY}),
root AS (SELECT digest FROM top WHERE m = 1),
nodes AS (SELECT tree, level, idx, m, digest FROM up UNION ALL SELECT -1, level, idx, m, digest FROM top),
beside AS (SELECT tree, level, idx, m,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // {ARITY} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // {ARITY} ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM nodes),
walk AS (SELECT r, tree AS own, tree, 0 AS level, rank AS idx, n AS m, '' AS proof, given AS digest FROM ranked
  UNION ALL SELECT w.r, w.own, b.tree, b.level + 1, b.idx // {ARITY}, (b.m + {ARITY - 1}) // {ARITY}, w.proof || b.before || b.after, sha256(b.before || w.digest || b.after)
  FROM walk w JOIN beside b ON w.tree = b.tree AND w.level = b.level AND w.idx = b.idx WHERE w.m > 1
),
inner_end AS (SELECT r, own, proof, digest FROM walk WHERE m = 1),
rise AS (SELECT r, 0 AS level, own AS idx, (SELECT count(*) FROM sub) AS m, proof, digest FROM inner_end
  UNION ALL SELECT w.r, w.level + 1, w.idx // {ARITY}, (w.m + {ARITY - 1}) // {ARITY}, w.proof || b.before || b.after, sha256(b.before || w.digest || b.after)
  FROM rise w JOIN beside b ON b.tree = -1 AND w.level = b.level AND w.idx = b.idx WHERE w.m > 1)
SELECT k.doc_id, k.leaf, s.digest AS subroot, root.digest AS root, sha256(e.proof) AS proof_sha256, e.digest AS folded_root, e.digest = root.digest AS verified
FROM ranked k JOIN sub s ON k.tree = s.tree JOIN rise e ON e.r = k.r AND e.m = 1, root
"""
