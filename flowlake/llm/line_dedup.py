"""Line dedup: a sharded minimal perfect hash over distinct line hashes.

Blocks of documents give a row for each distinct line key they hold: its 128-bit hash and the number of the block's
documents with it. Summed by hash, these are the distinct lines of the corpus. They are dealt to shards, and each shard
builds a minimal perfect hash (levels of bit arrays, a key rests at the first level where its slot is its own), which indexes
a compact array of 16-bit fingerprints and one of counts. The shard's arrays are one row. The blocks'
keys then probe the arrays, shard by shard, and only those of lines found in at least ``min_docs`` documents return
to their blocks, where these lines go. All rows grow with the lines; a line that all documents share is one row a block.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; keys are told apart by a
128-bit hash. Defined results: null or empty text is one empty line, which stays; keys shorter than
``min_chars`` code points stay; rows with equal or null doc_id are separate documents; other columns are ignored; an
empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm import blocks as B
from flowlake.llm.words import KEY, mix

SPACES = b" \t\n\r\x0b\x0c"
KEYS, INDEX = "block int, hi long, lo long, docs long", "shard int, n_keys long, index binary"
_KEYS = pa.schema([("block", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("docs", pa.int64())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(mix(keys["hi"]) + keys["lo"] + np.uint64((int(_STEP) * (level + 1)) % (1 << 64))) % np.uint64(size)).astype(np.int64)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys["lo"] ^ mix(keys["hi"])) >> np.uint64(48)).astype(np.uint16)


def build_index(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Serialized minimal perfect hash of the distinct KEY rows with fingerprint and count arrays."""
    sizes, bits, rest = [], [], keys
    while len(rest):
        size = (3 * len(rest) // 128 + 1) * 64
        slot = _slots(rest, len(sizes), size)
        alone = np.bincount(slot, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(alone))
        rest = rest[~alone[slot]]
    head = np.array([len(keys), len(sizes), *sizes], np.int64)
    empty = [head.tobytes(), *(b.tobytes() for b in bits)]
    if not len(keys):
        return b"".join(empty)
    at = Index(b"".join(empty)).places(keys)
    prints, found = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.uint32)
    prints[at], found[at] = _fingerprint(keys), counts
    return b"".join([*empty, prints.tobytes(), found.tobytes()])


class Index:
    """The arrays of a shard, read once for any number of probes."""

    def __init__(self, index: bytes):
        n, levels = np.frombuffer(index, np.int64, 2)
        offset, before, self.levels = 16 + 8 * int(levels), 0, []
        for size in np.frombuffer(index, np.int64, int(levels), 16).tolist():
            bits = np.unpackbits(np.frombuffer(index, np.uint8, size // 8, offset)).astype(bool)
            self.levels.append((size, bits, np.cumsum(bits) - 1 + before))
            offset, before = offset + size // 8, before + int(bits.sum())
        arrays = len(index) > offset
        self.prints = np.frombuffer(index, np.uint16, int(n), offset) if arrays else np.zeros(0, np.uint16)
        self.counts = np.frombuffer(index, np.uint32, int(n), offset + 2 * int(n)) if arrays else np.zeros(0, np.uint32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each indexed key; -1, or that of another key, for others."""
        place, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits, rank) in enumerate(self.levels):
            slot = _slots(keys[left], level, size)
            hit = bits[slot]
            place[left[hit]] = rank[slot[hit]]
            left = left[~hit]
        return place

    def lookup(self, keys: np.ndarray, missing: int = 0) -> np.ndarray:
        """Counts of the keys, ``missing`` for those without their fingerprint in the index."""
        place = self.places(keys)
        known = np.flatnonzero(place >= 0)
        known = known[self.prints[place[known]] == _fingerprint(keys[known])]
        out = np.full(len(keys), missing, np.int64)
        out[known] = self.counts[place[known]]
        return out


def _lines(table: pa.Table, min_chars: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Lines of each document; hashes of their keys (zeros for too short ones) and the documents' offsets."""
    docs, hashes, at, total = [], [], [0], 0
    for text in table["text"]:
        lines = (text.as_py() or "").encode().split(b"\n")
        for line in lines:
            key = line.strip(SPACES).lower()
            short = len(key) < min_chars or min_chars > 1 and len(key.decode()) < min_chars
            hashes.append(b"\0" * 16 if short else xxhash.xxh3_128_digest(key))
        docs.append(lines)
        total += len(lines)
        at.append(total)
    return docs, np.frombuffer(b"".join(hashes), KEY), np.array(at)


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and for each hash the place of its own."""
    order = np.lexsort((hashes["lo"], hashes["hi"]))
    own = hashes[order]
    first = np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    inverse = np.zeros(len(own), np.int64)
    inverse[order] = np.cumsum(first) - 1
    return own[first], inverse


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


def _keys(table: pa.Table) -> np.ndarray:
    out = np.zeros(len(table), KEY)
    for c in ("hi", "lo"):
        out[c] = table[c].to_numpy().view(np.uint64)
    return out


def _ask(min_chars: int):
    def ask(table: pa.Table) -> pa.Table:
        _, hashes, at = _lines(table, min_chars)
        keys, inverse = _distinct(hashes)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        pairs = np.unique(inverse * np.int64(len(at)) + doc)  # a line counts once a document
        docs = np.bincount(pairs // len(at), minlength=len(keys))
        some = (keys["hi"] != 0) | (keys["lo"] != 0)
        block = pa.array(np.full(int(some.sum()), table["block"][0].as_py()), pa.int32())
        return pa.table([block, _long(keys["hi"][some]), _long(keys["lo"][some]), pa.array(docs[some], pa.int64())], schema=_KEYS)

    return ask


def _build(table: pa.Table) -> pa.Table:
    counts = np.minimum(table["docs"].to_numpy(), 0xFFFFFFFF).astype(np.uint32)
    index = build_index(_keys(table), counts)
    return pa.table([table["shard"].slice(0, 1).cast(pa.int32()), pa.array([len(table)], pa.int64()), pa.array([index], pa.binary())], names=["shard", "n_keys", "index"])


def _probe(min_docs: int):
    def probe(table: pa.Table, index: pa.Table) -> pa.Table:
        found = Index(index["index"][0].as_py() if len(index) else build_index(np.zeros(0, KEY), np.zeros(0)))
        return table.select(["block", "hi", "lo"]).filter(pa.array(found.lookup(_keys(table)) >= min_docs))

    return probe


def _finish(min_chars: int, digest: bool):
    def finish(table: pa.Table, common: pa.Table) -> pa.Table:
        docs, hashes, at = _lines(table, min_chars)
        keys, inverse = _distinct(hashes)
        gone_keys = np.isin(keys, _keys(common)) if len(common) else np.zeros(len(keys), bool)
        drop = gone_keys[inverse]
        dropped, kept = [], []
        for i, lines in enumerate(docs):
            gone = drop[at[i] : at[i + 1]]
            text = b"\n".join([x for x, g in zip(lines, gone) if not g] if gone.any() else lines)
            dropped.append(int(gone.sum()))
            kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
        return pa.table([table["doc_id"], pa.array(np.diff(at)), pa.array(dropped, pa.int64()), pa.array(kept, pa.string()), table["rest"]], schema=_RESULT.append(table.schema.field("rest")))

    return finish


def _sharded(blocks: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """KEYS rows of the blocks, each in its shard."""
    asked = blocks.groupBy("block").applyInArrow(_ask(min_chars), KEYS)
    return asked.withColumn("shard", F.pmod(F.xxhash64("hi", "lo"), F.lit(shards)).cast("int")).repartition("shard")


def _index(asked: DataFrame) -> DataFrame:
    return asked.groupBy("shard", "hi", "lo").agg(F.sum("docs").alias("docs")).groupBy("shard").applyInArrow(_build, INDEX)


def line_index(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row a shard: its number of distinct lines and the serialized arrays (see ``Index``)."""
    n = B.block_count(docs)
    return _index(_sharded(B.with_block(docs, n), n, min_chars))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, digest: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped and ``kept``: the remaining lines joined by \\n, or with digest their SHA-256;
    then the columns to keep."""
    n = B.block_count(docs)
    blocks = B.with_block(docs, n, keep)
    asked = _sharded(blocks, n, min_chars)
    common = asked.groupBy("shard").cogroup(_index(asked).groupBy("shard")).applyInArrow(_probe(min_docs), "block int, hi long, lo long")
    schema = B.schema_with_rest("doc_id long, n_lines long, n_dropped long, kept string", blocks)
    out = blocks.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(_finish(min_chars, digest), schema)
    return B.with_rest(out, keep)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_common_lines(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH lines AS (
  SELECT row, doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM (SELECT *, row_number() OVER () AS row FROM documents))),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN c.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM lines LEFT JOIN common c USING (key) GROUP BY row
"""
