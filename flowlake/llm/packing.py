"""Best-fit decreasing packing of tokenized documents into sequences of fixed capacity.

Spark tasks tokenize the documents and cut those longer than a sequence. Only the histogram of piece lengths (one
row for each length up to the capacity, whatever the corpus) reaches the driver, where best-fit decreasing runs over
it: a segment tree over the remaining capacities finds the tightest open bin in logarithmic time. Pieces of one
length are placed in runs, exactly as one by one: after a piece, the tightest bin for the next one of its length is
the same bin while it has room. Each piece then finds its place from its rank within its length, which counts by
shard, so that a very common length is spread.

Defined results: null text is empty text, one piece with the end id alone; rows with equal or null doc_id are packed
each on its own; other columns are ignored; an empty table has no sequences.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.bpe import tokenizer, vocabulary_path
from flowlake.tables import materialize

CAPACITY, END, CACHE, ROWS, SHARD = 2048, 0, 1_000_000, 64, 100_000
_LATE_SPACE = re.compile(r"\s ")
_PLAIN = re.compile("[ -;=-~\n\u00c0-\u024f]+")
_ranks: dict[str, object] = {}
# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = re.compile(r"(?<!\s) ")
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def units(text: str) -> list[str]:
    """The text cut before every space that follows a character other than white space. A byte-level BPE's
    pre-tokens never reach over such a place, so the ids of the text are those of its units."""
    parts = _SPLIT.split(text) if _LATE_SPACE.search(text) else text.split(" ")
    return parts[:1] + [" " + p for p in parts[1:]]


def rank_encoder(path: str | None):
    """Encoder of the same merges from a file of ranks, about twice as fast; it knows no special tokens."""
    if path and path not in _ranks:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ranks[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _ranks.get(path)


class UnitCache(dict):
    """Packed ids of units, bounded in number. Units of plain letters and signs go to the rank encoder, all others,
    such as those that may hold a special token, to the tokenizer; both give the same ids."""

    def __init__(self, path: str, ranks: str | None = None, most: int = CACHE):
        self.path, self.fast, self.most = path, rank_encoder(ranks), most

    def add(self, wanted: set[str]) -> None:
        if len(self) > self.most:
            self.clear()
        rest, fast, plain = [], self.fast, _PLAIN.fullmatch
        for unit in wanted - self.keys():
            if fast and plain(unit):
                self[unit] = array("I", fast(unit)).tobytes()
            else:
                rest.append(unit)
        for unit, e in zip(rest, tokenizer(self.path).encode_batch_fast(rest, add_special_tokens=False)):
            self[unit] = array("I", e.ids).tobytes()


def cuts(length: int, capacity: int) -> list[int]:
    """Piece boundaries: all pieces but the first have the full capacity."""
    first = length % capacity if length > capacity else length
    return [0, *range(first or capacity, length + 1, capacity)]


def _tokenize(path: str, capacity: int, end: int, keep_ids: bool, ranks: str | None = None):
    def run(batches):
        cache, last = UnitCache(path, ranks), np.array([end], "<u4").tobytes()
        whole = lambda text: array("I", cache.fast(text)).tobytes() if cache.fast and _PLAIN.fullmatch(text) else None
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                texts = [x.as_py() or "" for x in part["text"]]
                docs = [whole(x) or units(x) for x in texts]  # a plain text in one call: many words occur once, which a cache only burdens
                cache.add({u for d in docs if type(d) is list for u in d})
                rows = []
                for doc, own in zip(part["doc_id"].to_pylist(), docs):
                    ids = (b"".join(map(cache.__getitem__, own)) if type(own) is list else own) + last
                    at = cuts(len(ids) // 4, capacity)
                    for k, (a, b) in enumerate(zip(at, at[1:])):
                        own_ids = ids[4 * a : 4 * b]
                        rows.append((doc, k, a, b - a, zlib.crc32(own_ids)) + ((np.frombuffer(own_ids, "<u4"),) if keep_ids else ()))
                schema = _PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if keep_ids else _PIECES
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False, ranks: str | None = None) -> DataFrame:
    """Pieces of at most capacity tokens: doc_id, piece, start, length, ids_crc32 and, if wanted, the ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(_tokenize(path, capacity, end, keep_ids, ranks), schema)


class CapacityTree:
    """Segment tree over the remaining capacities 0..n: whether any open bin has one."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.some = [False] * (2 * self.size)

    def set(self, c: int, value: bool) -> None:
        i = c + self.size
        while i and self.some[i] != value:
            self.some[i] = value
            i //= 2
            value = value or i > 0 and (self.some[2 * i] or self.some[2 * i + 1])

    def tightest(self, c: int) -> int | None:
        """The smallest capacity of an open bin that is at least c."""
        i = c + self.size
        if self.some[i]:
            return c
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces a bin, first bin, offset) in order of length and rank: the piece of rank r
    in its length goes to bin first + (r - rank) // pieces, at offset + (r - rank) % pieces * length."""
    tree, bins = CapacityTree(capacity), {}
    runs, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            first, count = bins[room].pop() if room is not None else (opened, left)
            offset = capacity - room if room is not None else 0
            each = (room or capacity) // length
            full, over = min(count, left // each), left % each if left // each < count else 0
            if room is None:
                count = full + bool(over)
                opened += count
            elif not bins[room]:
                tree.set(room, False)
            runs.append((length, rank, each, first, offset))
            for at, many, taken in ((first, full, each), (first + full, bool(over), over), (first + full + bool(over), count - full - bool(over), 0)):
                rest = capacity - offset - taken * length
                if many and rest:
                    bins.setdefault(rest, []).append((at, many))
                    tree.set(rest, True)
            rank += full * each + over
            left -= full * each + over
    return runs


def _place(runs: np.ndarray):
    key = runs[:, 0] << 40 | runs[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            i = np.searchsorted(key, length << 40 | rank, side="right") - 1
            past = rank - runs[i, 1]
            columns = [c for c in batch.schema.names if c != "rank"]
            places = [pa.array(runs[i, 3] + past // runs[i, 2], pa.int64()), pa.array(runs[i, 4] + past % runs[i, 2] * length, pa.int64())]
            yield pa.record_batch([*(batch[c] for c in columns), *places], names=[*columns, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece and length) and for each its sequence_id and offset. pieces is read three times:
    give it as a written table."""
    found = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row a length
    if any(x < 1 or x > capacity for x in found):
        raise ValueError("lengths must be between 1 and the capacity")
    runs = np.array(sorted(best_fit_decreasing(found, capacity)), np.int64).reshape(-1, 5)
    shards = max(1, -(-sum(found.values()) // SHARD))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    counts = dealt.groupBy("shard", "length").count()
    before = counts.select("shard", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("shard")) - F.col("count")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "length").orderBy("doc_id", "piece")))
    ranked = ranked.join(before, ["shard", "length"]).withColumn("rank", F.col("rank") - 1 + F.col("before")).select(*pieces.columns, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(runs), schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    ranks = None if path else vocabulary_path("byte_bpe_50k.tiktoken")
    path = path or vocabulary_path("byte_bpe_50k.json")
    return pack(materialize(tokenize(docs, path, capacity, keep_ids=keep_ids, ranks=ranks), "pieces"), capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
