"""N-gram Jaccard join: components of documents whose word-shingle sets overlap by a share.

1. Copies of a text collapse in the tasks that read them. Blocks of the distinct texts ask hash buckets in how many of them
   each shingle occurs (block exchange of packed fingerprints). Texts with equal sets are one class. A class of which fewer
   than ``percent`` of the shingles occur elsewhere can link with nothing and is done.
2. The others meet in tiles by the smallest hash of their set under two mixes. A tile holds a bounded number of classes;
   of a larger group about ``LEADS`` classes go to all its tiles, so that copies of one document come together. Linked
   classes become components; pairs within one are compared no more.
3. What is left is exact: two sets that link share one of their rarest n - ceil(percent * n) + 1 shingles. Shingles that the
   same classes hold count once. Where such a shingle occurs in more than one component, the classes outside its largest
   component (probes) are compared with all its classes (builds) in size-banded tiles: bands are as wide as the ratio of
   sizes that can link, so only neighbouring bands meet, and probes and builds of a band are dealt to tiles of at most about
   ``TILE`` of each. Within a tile the sizes, the places of the shingle in the two orders and the bit counts of hashed
   bitmaps bound the overlap from above. Rows with a partner that these leave get their sorted arrays, and meet again in
   their tile for the exact intersections. A tile returns rows, and then the links that join components, at most one fewer than
   it has classes, never its pairs.

Defined results: a text with fewer words than the shingle is one shingle; without words, the set is empty and links
with nothing; rows with one doc_id are one node, whatever their texts; rows without doc_id are documents each, and a component
without any doc_id has a null component_id; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm import blocks as B
from flowlake.llm.components import connected_components
from flowlake.llm.words import mix, shingle_set, word_hashes
from flowlake.tables import discard, materialize

WORDS, PERCENT, TILE, LEADS = 5, 75, 256, 8
BITS = 2048
_SETS = "key binary, n long, d1 long, d2 long, shingles binary, prefix array<long>, place array<long>, k1 long, k2 long"
_SETS_ARROW = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("shingles", pa.binary()), ("prefix", pa.list_(pa.int64())), ("place", pa.list_(pa.int64())), ("k1", pa.int64()), ("k2", pa.int64())])
_EDGES = "a long, b long"
_MIXES = (np.uint64(0x51ED27), np.uint64(0xA3C59AC3))


def _first_of_each(n: int):
    def run(batches):
        """The texts of a task without copies, each dealt to the block of its key."""
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for i, key in enumerate(batch["key"].to_pylist()):
                if key not in seen:
                    seen.add(key)
                    rows.append(i)
            part = batch.take(pa.array(rows, pa.int64()))
            block = [int.from_bytes(k[:8]) % n for k in part["key"].to_pylist()]
            yield pa.record_batch([pa.array(block, pa.int32()), part["key"], part["text"]], names=["block", "key", "text"])

    return run


def _block_sets(table: pa.Table, size: int) -> tuple[list[bytes], list[np.ndarray]]:
    """Keys and shingle sets of the block's distinct texts."""
    keys = table["key"].to_pylist()
    first = sorted(dict(zip(reversed(keys), range(len(keys) - 1, -1, -1))).values())
    words, at = word_hashes(table["text"].take(pa.array(first, pa.int64())), lower=True)
    return [keys[i] for i in first], [shingle_set(words[at[i] : at[i + 1]], size) for i in range(len(first))]


def _fingerprints(sets: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of all shingles (bucket, 32-bit fingerprint), the place of each shingle's own, and their counts."""
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    keys = ((every >> np.uint64(32)) % np.uint64(n)) << np.uint64(32) | (every & np.uint64(0xFFFFFFFF))
    return np.unique(keys, return_inverse=True, return_counts=True)


SLICE = 1 << 18  # keys of a bucket that are counted at once


def _ask(n: int, size: int):
    def ask(table: pa.Table) -> pa.Table:
        keys, _, counts = _fingerprints(_block_sets(table, size)[1], n)
        at, low, pack = B.bucket_offsets(keys >> np.uint64(32), n), keys.astype(np.uint32), zstandard.ZstdCompressor(level=1)
        counts = counts.astype(np.uint32)
        rows = ((k, np.uint32(at[k + 1] - at[k]).tobytes() + low[at[k] : at[k + 1]].tobytes() + pack.compress(counts[at[k] : at[k + 1]].tobytes())) for k in range(n) if at[k + 1] > at[k])
        return B.payload_table(table["block"][0].as_py(), rows)

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """In how many texts each key occurs."""
    low, counts = [], []
    for p in B.payloads(table):
        m = int(np.frombuffer(p, np.uint32, 1)[0])
        low.append(np.frombuffer(p, np.uint32, m, 4))
        counts.append(np.frombuffer(zstandard.decompress(p[4 + 4 * m :]), np.uint32))
    total, pack = [np.zeros(len(x), np.uint32) for x in low], zstandard.ZstdCompressor(level=1)
    slices = 1 + sum(map(len, low)) // SLICE  # a payload's keys ascend, so those of a range of keys stand together in each
    edges = [(k << 32) // slices for k in range(1, slices)]
    cuts = [np.concatenate([[0], np.searchsorted(x, np.array(edges, np.uint32)), [len(x)]]) for x in low]
    for k in range(slices):
        spans = [slice(c[k], c[k + 1]) for c in cuts]
        keys, inverse = np.unique(np.concatenate([x[r] for x, r in zip(low, spans)]), return_inverse=True)
        sums, at = np.bincount(inverse, np.concatenate([x[r] for x, r in zip(counts, spans)]), len(keys)).astype(np.uint32)[inverse], 0
        for t, r in zip(total, spans):
            t[r] = sums[at : at + r.stop - r.start]
            at += r.stop - r.start
    return B.answers_table(table, [pack.compress(t.tobytes()) for t in total])


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _finish(size: int, percent: int, n: int):
    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _SETS_ARROW.empty_table()
        names, sets = _block_sets(table, size)
        keys, inverse, _ = _fingerprints(sets, n)
        found, to = np.zeros(len(keys), np.uint32), B.bucket_offsets(keys >> np.uint64(32), n)
        for k, payload in B.by_bucket(answers).items():
            found[to[k] : to[k + 1]] = np.frombuffer(zstandard.decompress(payload), np.uint32)
        found, at, out = found[inverse], 0, []
        for name, s in zip(names, sets):
            df = found[at : at + len(s)]
            at += len(s)
            digest = xxhash.xxh3_128_intdigest(s.tobytes())
            halves = np.array([digest >> 64, digest & (1 << 64) - 1], np.uint64).view(np.int64).tolist() if len(s) else (None, None)
            own = (None,) * 5
            if len(s) and 100 * int((df > 1).sum()) >= percent * len(s):
                rarest = np.lexsort((s, df))[: prefix_size(len(s), percent)]
                place = np.flatnonzero(df[rarest] > 1)
                own = (s.tobytes(), s[rarest[place]].view(np.int64), place, *(int(mix(s ^ c).min().view(np.int64)) for c in _MIXES))
            out.append((name, len(s), *halves, *own))
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out), _SETS_ARROW)], schema=_SETS_ARROW)

    return finish


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """Least overlap with which sets of a and b elements link."""
    return -(-percent * (a + b) // (100 + percent))


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    bits = np.zeros((len(sets), BITS), bool)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits[row, np.concatenate(sets) % np.uint64(BITS) if sets else []] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def may_link(n: int, bits: np.ndarray, others: np.ndarray, other_bits: np.ndarray, percent: int) -> np.ndarray:
    """Which of the others are of a size to link with, and not ruled out by bits that only one side has."""
    out = (others * percent <= 100 * n) & (n * percent <= 100 * others)
    at = np.flatnonzero(out)
    if len(at):
        mine = n - np.bitwise_count(bits & ~other_bits[at]).sum(axis=1, dtype=np.int64)
        theirs = others[at] - np.bitwise_count(other_bits[at] & ~bits).sum(axis=1, dtype=np.int64)
        out[at] = np.minimum(mine, theirs) >= needed(n, others[at], percent)
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    i = np.searchsorted(a, b)
    i[i == len(a)] = len(a) - 1
    return int((a[i] == b).sum())


class _Tile:
    """Classes of a tile with their sets, and the links found so far."""

    def __init__(self, table: pa.Table, percent: int, labels: np.ndarray | None = None):
        self.sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        self.sizes, self.ids, self.percent = table["n"].to_numpy(), table["cls"].to_numpy(), percent
        self.bits, self.label, self.edges = bitmaps(self.sets), np.arange(len(self.sets)) if labels is None else labels.copy(), []

    def compare(self, i: int, others: np.ndarray) -> None:
        """Link i with those of the others that are not yet of its component."""
        others = others[self.label[others] != self.label[i]]
        for j in others[may_link(int(self.sizes[i]), self.bits[i], self.sizes[others], self.bits[others], self.percent)]:
            if self.label[i] != self.label[j] and _overlap(self.sets[i], self.sets[j]) >= needed(int(self.sizes[i]), int(self.sizes[j]), self.percent):
                self.edges.append((self.ids[i], self.ids[j]))
                self.label[self.label == self.label[j]] = self.label[i]

    def links(self) -> pa.Table:
        return pa.table([pa.array([e[k] for e in self.edges], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _tile(percent: int):
    def tile(table: pa.Table) -> pa.Table:
        one = _Tile(table.sort_by("n"), percent)
        for i in range(len(one.sets) - 1):
            one.compare(i, np.arange(i + 1, len(one.sets)))
        return one.links()

    return tile


_ROW = "token long, pb int, bb int, pp int, bp int, cls long, n long, place long, component long, outside boolean, probe boolean"
_TILE_KEY = ("token", "pb", "bb", "pp", "bp")


def _in_reach(table: pa.Table, percent: int):
    """Each probe of a tile, and its builds for which sizes and places of the token leave enough overlap."""
    sizes, ids, place, component = (table[c].to_numpy() for c in ("n", "cls", "place", "component"))
    probe, also = (table[c].to_numpy(zero_copy_only=False) for c in ("probe", "outside"))
    build, room = np.flatnonzero(~probe), sizes - place
    for i in np.flatnonzero(probe):
        others = build[(~also[build] | (ids[build] > ids[i])) & (component[build] != component[i])]  # two probes meet once
        others = others[np.minimum(room[i], room[others]) >= needed(int(sizes[i]), sizes[others], percent)]
        if len(others):
            yield i, others


def _sift_tile(percent: int):
    def tile(table: pa.Table) -> pa.Table:
        """The rows of the tile with a partner that sizes, places and bitmaps don't rule out."""
        sizes, bits = table["n"].to_numpy(), np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in table["bits"]), np.uint64).reshape(len(table), -1)
        some = np.zeros(len(table), bool)
        for i, others in _in_reach(table, percent):
            near = others[may_link(int(sizes[i]), bits[i], sizes[others], bits[others], percent)]
            some[near] = True
            some[i] |= len(near) > 0
        return table.drop_columns(["bits"]).filter(pa.array(some))

    return tile


def _probe_tile(percent: int):
    def tile(table: pa.Table) -> pa.Table:
        one = _Tile(table, percent, table["component"].to_numpy())
        for i, others in _in_reach(table, percent):
            one.compare(i, others)
        return one.links()

    return tile


def _bits(batches):
    for batch in batches:
        rows = bitmaps([np.frombuffer(x.as_buffer(), np.uint64) for x in batch["shingles"]])
        yield pa.record_batch([batch["cls"], pa.array([r.tobytes() for r in rows], pa.binary())], names=["cls", "bits"])


def _by_smallest_hash(pending: DataFrame, percent: int) -> DataFrame:
    """Links found in tiles of about TILE classes that share a smallest hash."""
    keys = pending.select("cls", F.posexplode(F.array("k1", "k2")).alias("which", "key"))
    groups = keys.groupBy("which", "key").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / TILE).cast("int"))
    leads = (F.col("parts") > 1) & (F.pmod(F.xxhash64("cls", "key"), "count") < LEADS)
    part = F.when(leads, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cls"), "parts").cast("int")))
    dealt = keys.join(groups, ["which", "key"]).select("cls", "which", "key", F.explode(part).alias("part"))
    return dealt.join(pending.select("cls", "n", "shingles"), "cls").groupBy("which", "key", "part").applyInArrow(B.released(_tile(percent)), _EDGES)


def _postings(pending: DataFrame, components: DataFrame) -> DataFrame:
    """token, cls, n, place, component and outside (of the token's largest component) of prefix shingles in several components;
    of the shingles that the same classes hold one, with the first place."""
    known = components.select(F.col("node").alias("cls"), "component")
    rows = pending.select("cls", "n", F.explode(F.arrays_zip("prefix", "place")).alias("p")).select("cls", "n", F.col("p.prefix").alias("token"), "p.place")
    rows = rows.join(known, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    held = rows.groupBy("token", "component").agg(F.count("*").alias("count"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y"))
    spread = held.groupBy("token").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("count"), F.count("*").alias("several"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("several > 1")
    same = spread.groupBy("count", "x", "y").agg(F.min("token").alias("lead"))
    spread = spread.join(same, ["count", "x", "y"]).select("token", "lead", "main")
    out = rows.join(spread, "token").groupBy(F.col("lead").alias("token"), "cls", "n", "component", "main").agg(F.min("place").alias("place"))
    return out.withColumn("outside", F.col("component") != F.col("main")).drop("main")


def _rest(pending: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Links between the components, by the shingles of the prefixes that lie in more than one of them."""
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * 1.001)).cast("int")
    rows = materialize(_postings(pending, components).withColumn("band", band), "postings")
    parts = lambda c: F.ceil(c / TILE).cast("int")
    bands = rows.groupBy("token", "band").agg(parts(F.count("*")).alias("builds"), parts(F.sum(F.col("outside").cast("int"))).alias("probes"))
    own = bands.select("token", "band", F.col("builds").alias("b"), F.col("probes").alias("p"))
    near = rows.join(own, ["token", "band"]).withColumn("other", F.explode(F.array(*(F.col("band") + F.lit(i) for i in (-1, 0, 1)))))
    near = near.join(bands.withColumnRenamed("band", "other"), ["token", "other"])
    at = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = ("cls", "n", "place", "component", "outside", "token")
    probes = near.where("outside").select(*row, F.lit(True).alias("probe"), F.col("band").alias("pb"), F.col("other").alias("bb"), at("p").alias("pp"), each("builds").alias("bp"))
    builds = near.where("probes > 0").select(*row, F.lit(False).alias("probe"), F.col("other").alias("pb"), F.col("band").alias("bb"), each("probes").alias("pp"), at("b").alias("bp"))
    names = [f.split()[0] for f in _ROW.split(", ")]
    marks = pending.select("cls", "shingles").mapInArrow(_bits, "cls long, bits binary")
    tiles = probes.unionByName(builds).join(marks, "cls").select(*names, "bits")
    sifted = materialize(tiles.groupBy(*_TILE_KEY).applyInArrow(B.released(_sift_tile(percent)), _ROW), "tiles")
    return sifted.join(pending.select("cls", "shingles"), "cls").groupBy(*_TILE_KEY).applyInArrow(B.released(_probe_tile(percent)), _EDGES)


def _of_one_id(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges between the classes of rows with one doc_id."""
    several = ids.where("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("doc_id")
    own = ids.join(several, "doc_id").select("doc_id", "key").distinct().join(texts.where("cls is not null").select("key", "cls"), "key")
    least = own.groupBy("doc_id").agg(F.min("cls").alias("a"))
    return own.join(least, "doc_id").where("cls > a").select("a", F.col("cls").alias("b"))


def text_key():
    """The digest of a text; that of no text is that of the empty one."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key")


def _nodes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """key, n_shingles, node (number of the component; null without words) and smallest (doc_id of the node) of every
    distinct text."""
    n = B.block_count(docs)
    buckets = B.bucket_count(n)
    blocks = docs.select(text_key(), "text").mapInArrow(_first_of_each(n), "block int, key binary, text string")
    sets = materialize(B.exchange(blocks, _ask(buckets, words), _answer, _finish(words, percent, buckets), _SETS, n), "sets")
    classes = sets.where("d1 is not null").select("d1", "d2").distinct().withColumn("cls", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    texts = sets.select("key", "n", "d1", "d2").join(classes, ["d1", "d2"], "left").select("key", "n", "cls")
    pending = sets.where("shingles is not null").dropDuplicates(["d1", "d2"]).join(classes, ["d1", "d2"])
    pending = materialize(pending.select("cls", "n", "shingles", "prefix", "place", "k1", "k2"), "pending")
    ids = docs.select("doc_id", text_key())
    found = materialize(_by_smallest_hash(pending, percent).unionByName(_of_one_id(ids, texts)), "links")
    more = _rest(pending, connected_components(found), percent)
    components = connected_components(found.unionByName(more))
    texts = texts.join(components.withColumnRenamed("node", "cls"), "cls", "left").select("key", F.col("n").alias("n_shingles"), F.coalesce("component", "cls").alias("node"))
    texts = materialize(texts.join(ids.groupBy("key").agg(F.min("doc_id").alias("least")), "key"), "texts")
    for table in (pending, classes, sets):
        discard(table)
    least = texts.where("node is not null").groupBy("node").agg(F.min("least").alias("smallest"))
    return texts.drop("least").join(least, "node", "left")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and node of every document (node: a number of its component, null without words)."""
    out = docs.select("doc_id", text_key()).join(_nodes(docs, words, percent), "key")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "node")


def first_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest doc_id (rows without one last,
    then by the digest of the text), once; rows without words stay."""
    found = docs.select("doc_id", text_key()).join(_nodes(docs, words, percent).select("key", "node"), "key")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    best = found.where("node is not null").groupBy("node").agg(F.min(order).alias("b")).select(F.col("b.doc_id").alias("best_id"), F.col("b.key").alias("best_key"))
    keyed = docs.select("doc_id", text_key().alias("own_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own_row"))  # the caller's columns may have any names
    rows = keyed.join(best, (F.col("own_key") == F.col("best_key")) & F.col("doc_id").eqNullSafe(F.col("best_id")))
    once = rows.groupBy("best_key", "best_id").agg(F.any_value("own_row").alias("own_row"))
    wordless = docs.where(F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r\x0b\x0c"))) == 0)
    return once.select("own_row.*").unionByName(wordless)


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingle AS (SELECT DISTINCT row, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM docs WHERE len(w) > 0)),
size AS (SELECT row, count(*) AS n FROM shingle GROUP BY row),
common AS (SELECT a.row AS a, b.row AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.row < b.row GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.row = a JOIN size y ON y.row = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT d.doc_id AS a, e.doc_id AS b FROM link JOIN docs d ON d.row = a JOIN docs e ON e.row = b UNION SELECT e.doc_id, d.doc_id FROM link JOIN docs d ON d.row = a JOIN docs e ON e.row = b),
reached AS (SELECT a AS id, b AS other FROM edge UNION SELECT r.id, e.b FROM reached r JOIN edge e ON r.other = e.a),
least AS (SELECT id, min(other) AS component FROM reached GROUP BY id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(least(doc_id, coalesce(component, doc_id)) AS BIGINT) AS component_id FROM docs LEFT JOIN size USING (row) LEFT JOIN least ON id = doc_id
"""
