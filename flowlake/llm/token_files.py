"""Token ids of documents in compressed binary files, and the way back.

``write_tokens`` encodes every document, appends the end id and writes all ids in ascending doc_id order. Three tables make up
the format, each a folder of Parquet files that any executor can read through Spark:

* ``blocks``: a row for each BLOCK ids of a shard (the last of a shard is shorter): the rANS words (see ``rans``), checkpoints
  for reading from within, a checksum of the bytes and one of the ids, and which documents lie where in it;
* ``frequencies``: the table that all blocks share (a row an id of the vocabulary);
* ``shards``: how many ids lie before each shard. A shard is a range of documents, so shards are written and read in parallel.

``read_documents`` decodes all blocks on their own, whatever document they begin or end in; checksums of a document's pieces
combine into that of the document. ``read_range`` decodes only the segments between two positions.

Defined results: null text is empty text, the end id alone; rows with a null doc_id come first; rows with one doc_id lie next to
each other, the shorter first, then by checksum; documents longer than a block span several, and a text of any length is
encoded as a whole; an empty table gives files without blocks and no rows; other columns are ignored. Bytes that
don't fit their checksums raise ValueError.
"""

from __future__ import annotations

import itertools
import math
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import rans
from flowlake.llm.bpe import encode_words, id_type, splits_at_spaces, tokenizer, vocabulary_path
from flowlake.llm.ranks import running_start
from flowlake.tables import discard, materialize, shared_root

BLOCK, AT_ONCE, SHARD_BYTES, PART, KNOWN = 4 * rans.SEGMENT, 16, 64 << 20, 12 << 20, 1_500_000
_TOKENS = "doc_id long, n_tokens long, crc long, row long, ids binary"
_BLOCKS = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("states", pa.binary()), ("places", pa.binary()), ("words", pa.binary()),
    ("bytes_crc", pa.int64()), ("ids_crc", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("doc_start", pa.list_(pa.int64())), ("begin", pa.list_(pa.int32())), ("after", pa.list_(pa.int64())),
])
_BLOCKS_DDL = "shard int, block int, first long, n_ids int, states binary, places binary, words binary, bytes_crc long, ids_crc long, doc_id array<long>, doc_start array<long>, begin array<int>, after array<long>"
_MARKS, _LETTERS = "".join(chr(c) for c in range(33, 127) if not (chr(c).isalnum() or chr(c) == "'")), "[A-Za-zÀ-ÖØ-öø-ÿ]*"
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}  # how byte-level vocabularies write these bytes
_WITHIN = {b: c for b, c in _BYTE_CHARS.items() if b != 32}
_encoders: dict[str, WordEncoder] = {}


class _Table:
    """Distinct strings by number, in the order in which they come."""

    def __init__(self, first: list[str]):
        self.values = pa.array(first, pa.string())

    def numbers(self, distinct: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The number of each of the distinct strings, and those among them that are new."""
        found = pc.index_in(distinct, self.values)
        fresh = distinct.filter(found.is_null())
        out = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        out[out < 0] = np.arange(len(self.values), len(self.values) + len(fresh))
        if len(fresh):
            self.values = pa.concat_arrays([self.values, fresh])
        return out, fresh


class WordEncoder:
    """Ids of texts whose words are encoded once each, as long as no more than ``limit`` of them are known. A word is one or two
    pieces. Letters and the ASCII marks behind them are written in the characters of the byte-level vocabulary and go straight to the
    merges of the model, many at a time; any other word is one piece and goes to the tokenizer. The last id of what the merges
    make of a piece, and no other, is one whose text has the end-of-word mark."""

    def __init__(self, path: str, limit: int = KNOWN):
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.limit, self.kind = path, limit, id_type(path)
        whole = tokenizer(path)
        mark = whole.model.end_of_word_suffix
        self.model = Tokenizer(whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.array([bool(mark) and (whole.id_to_token(i) or "").endswith(mark) for i in range(whole.get_vocab_size())])
        single = [_BYTE_CHARS.get(b, chr(b)) for b in range(256)]
        self.direct = bool(mark) and all(whole.token_to_id(c + mark) is not None for c in single)
        self.forget()

    def forget(self) -> None:
        self.words, self.pieces = _Table([""]), _Table([""])
        self.of_word = np.zeros((1, 2), np.int32)  # the pieces of each word
        self.start, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)  # of each piece in ids
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0

    def _merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of letters or marks, and how many each has."""
        ids = []
        for i in range(0, len(pieces), 4096):
            text = " ".join(pieces.slice(i, 4096).to_pylist())
            raw = text if text.isascii() else text.encode().decode("latin-1").translate(_WITHIN)
            ids += [np.array(e.ids, self.kind) for e in self.model.encode_batch_fast([raw], add_special_tokens=False)]
        flat = np.concatenate(ids) if ids else np.zeros(0, self.kind)
        return flat, np.diff(np.flatnonzero(self.last[flat]) + 1, prepend=0)

    def _whole(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes = encode_words(self.path, [w.encode() for w in words.to_pylist()])
        return np.array([i for x in codes for i in x], self.kind), np.array([len(x) for x in codes], np.int64)

    def learn(self, words: pa.Array) -> None:
        letters = pc.utf8_rtrim(words, characters=_MARKS)
        plain = pc.match_substring_regex(letters, f"^{_LETTERS}$") if self.direct else pa.array(np.zeros(len(words), bool))
        marks = pc.replace_substring_regex(words.filter(plain), f"^{_LETTERS}", "")
        odd = pc.binary_join_element_wise(words.filter(pc.invert(plain)), "", "\n")  # no other piece has a line's end
        coded = pa.concat_arrays([pc.utf8_lower(letters.filter(plain)), marks, odd]).dictionary_encode()
        number, fresh = self.pieces.numbers(coded.dictionary)
        number, is_plain = number[coded.indices.to_numpy()], plain.to_numpy(zero_copy_only=False)
        own, n = np.zeros((len(words), 2), np.int32), int(is_plain.sum())
        own[is_plain, 0], own[is_plain, 1], own[~is_plain, 0] = number[:n], number[n : 2 * n], number[2 * n :]
        self.of_word = np.concatenate([self.of_word, own])
        ends_line = pc.ends_with(fresh, "\n")
        direct, other = self._merged(fresh.filter(pc.invert(ends_line))), self._whole(pc.utf8_rtrim(fresh.filter(ends_line), characters="\n"))
        at = ends_line.to_numpy(zero_copy_only=False)
        size, start = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        for rows, (ids, sizes) in ((~at, direct), (at, other)):
            if self.used + len(ids) > len(self.ids):
                self.ids = np.append(self.ids, np.zeros(len(self.ids) + len(ids), self.kind))
            self.ids[self.used : self.used + len(ids)] = ids
            start[rows], size[rows] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used += len(ids)
        self.start, self.size = np.append(self.start, start), np.append(self.size, size)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        if len(self.words.values) > self.limit:
            self.forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        number, fresh = self.words.numbers(coded.dictionary)
        if len(fresh):
            self.learn(fresh)
        pieces = self.of_word[number[coded.indices.to_numpy()]].ravel()
        size = self.size[pieces]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(self.start[pieces] - ends[:-1], size) + np.arange(ends[-1])]
        at = ends[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())]
        return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PART bytes of text; a longer text is a slice."""
    total, lo = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy()), 0
    while lo < len(batch):
        hi = max(int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PART, side="right")), lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and crc with the end id, row, and the ids packed as the smallest unsigned integers that hold them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path)
        end = np.array([end_id], own.kind)
        for batch in batches:
            for part in slices(batch):
                ids = [np.append(x, end) for x in own.encode(part["text"])]
                crc = [zlib.crc32(x.astype("<u4")) for x in ids]
                columns = [part["doc_id"], pa.array(map(len, ids), pa.int64()), pa.array(crc, pa.int64()), part["row"], pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.record_batch(columns, names=["doc_id", "n_tokens", "crc", "row", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row")).mapInArrow(run, _TOKENS)


def id_counts(tokens: DataFrame, kind: type) -> DataFrame:
    """How often each id occurs in all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                found = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                if len(found) > len(total):
                    total = np.append(total, np.zeros(len(found) - len(total), np.int64))
                total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


class _Shard:
    """Blocks of one shard, from documents as they come."""

    def __init__(self, table: rans.Frequencies, number: int):
        self.table, self.number = table, number
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, start and end in the shard
        self.held = self.first = self.block = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = self.first + self.held
        self.ids.append(ids)
        self.docs.append((doc_id, start, start + len(ids)))
        self.held += len(ids)
        if self.held >= AT_ONCE * BLOCK:
            yield self.flush(self.held // BLOCK * BLOCK)

    def flush(self, n: int) -> pa.RecordBatch:
        flat = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint16)
        rows, most = [], int(self.table.freq.argmax())
        for lo in range(0, n, AT_ONCE * BLOCK):
            part = flat[lo : min(lo + AT_ONCE * BLOCK, n)]
            whole = len(part) // BLOCK * BLOCK
            coded = rans.encode(self.table, part[:whole].reshape(-1, BLOCK)) if whole else []
            if whole < len(part):  # the last of the shard: filled up to whole steps
                coded += rans.encode(self.table, np.append(part[whole:], np.full(-(len(part) - whole) % rans.LANES, most, part.dtype))[None, :])
            for k, code in enumerate(coded):
                rows.append(self.row(part[k * BLOCK : (k + 1) * BLOCK], code))
        self.ids, self.held = [flat[n:]] if n < len(flat) else [], len(flat) - n
        self.docs = [d for d in self.docs if d[2] > self.first]
        return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), _BLOCKS)], schema=_BLOCKS) if rows else pa.RecordBatch.from_pylist([], _BLOCKS)

    def row(self, ids: np.ndarray, code: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple:
        lo, hi = self.first, self.first + len(ids)
        gone = 0
        while gone < len(self.docs) and self.docs[gone][2] <= lo:
            gone += 1
        del self.docs[:gone]
        own = list(itertools.takewhile(lambda d: d[1] < hi, self.docs))
        parts = [x.astype(x.dtype.newbyteorder("<")).tobytes() for x in code]
        crc = zlib.crc32(parts[2], zlib.crc32(parts[1], zlib.crc32(parts[0])))
        out = (
            self.number, self.block, lo, len(ids), *parts, crc, zlib.crc32(ids.astype("<u4")),
            [d[0] for d in own], [d[1] for d in own], [max(d[1], lo) - lo for d in own], [max(d[2] - hi, 0) for d in own],
        )
        self.first, self.block = hi, self.block + 1
        return out


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> str:
    """Write the files into folder (by default a new one in the shared folder) and return it."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    if not splits_at_spaces(path):
        raise ValueError("the tokenizer must drop white space")
    folder = folder or f"{shared_root(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    kind = id_type(path)
    tokens = materialize(tokenize(docs, path, end_id), "tokens")
    found = id_counts(tokens, kind).toPandas()  # a row an id of the vocabulary at most
    counts = np.zeros(max(tokenizer(path).get_vocab_size(), end_id + 1), np.int64)
    counts[found["id"]] = found["n"]
    freq = rans.Frequencies.of_counts(counts).freq.astype(np.int64)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id int, freq long").coalesce(1).write.parquet(f"{folder}/frequencies")
    total = int(counts.sum()) * np.dtype(kind).itemsize
    shards = max(1, math.ceil(total / SHARD_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (1 << 20))))
    order = ["doc_id", "n_tokens", "crc", "row"]

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(rans.Frequencies(freq), TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), batch["ids"]):
                yield from shard.add(doc_id, np.frombuffer(ids.as_buffer(), kind))
        yield shard.flush(shard.held)

    # the number of shards is named, so that a task's number is its place in the order
    tokens.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(blocks, _BLOCKS_DDL).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("n_ids"))
    running_start(sizes, [], "shard", "n_ids").write.parquet(f"{folder}/shards")
    discard(tokens)
    return folder


def frequencies(spark: SparkSession, folder: str) -> np.ndarray:
    found = spark.read.parquet(f"{folder}/frequencies").toPandas()
    out = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    out[found["id"]] = found["freq"]
    return out


def _decoded(table: rans.Frequencies, batch: pa.RecordBatch, lo: int = 0, hi: int | None = None) -> list[tuple[int, np.ndarray]]:
    """For each block of the batch its ids from the first checkpoint at or before lo to the segment that holds hi - 1, with
    the place of the first in the block; whole blocks where no range is given."""
    blocks, segments = [], {}
    stream, base = [], 0
    for row in batch.select(["first", "n_ids", "states", "places", "words", "bytes_crc"]).to_pylist():
        if zlib.crc32(row["words"], zlib.crc32(row["places"], zlib.crc32(row["states"]))) != row["bytes_crc"]:
            raise ValueError(f"a block of ids from {row['first']} on doesn't fit its checksum")
        states = np.frombuffer(row["states"], "<u8").reshape(-1, rans.LANES)
        places, words = np.frombuffer(row["places"], "<u4"), np.frombuffer(row["words"], "<u4")
        steps = -(-row["n_ids"] // rans.LANES)
        a, b = max(lo - row["first"], 0), row["n_ids"] if hi is None else min(hi - row["first"], row["n_ids"])
        found = range(a // rans.SEGMENT, -(-b // rans.SEGMENT))
        out = [None] * len(found)
        for k in found:
            n = min(rans.STEPS, steps - k * rans.STEPS)
            then = states[k + 1] if k + 1 < len(states) else np.full(rans.LANES, 1 << 32, np.uint64)
            segments.setdefault(n, []).append((out, k - found.start, states[k], places[k] + base, then))
        blocks.append((found.start * rans.SEGMENT, out, row["n_ids"]))
        stream.append(words)
        base += len(words)
    stream = np.concatenate(stream) if stream else np.zeros(0, np.uint32)
    for n, own in segments.items():
        ids, last = rans.decode(table, np.stack([s[2] for s in own]), np.array([s[3] for s in own], np.int64), stream, n)
        if not np.array_equal(last, np.stack([s[4] for s in own])):
            raise ValueError("a segment doesn't end in the state of the next checkpoint")
        for (out, k, *_), x in zip(own, ids):
            out[k] = x
    return [(start, np.concatenate(out)[: n - start] if out else np.zeros(0, np.uint16)) for start, out, n in blocks]


_POLYNOMIAL = 0xEDB88320


def _product(a: int, b: int) -> int:
    """Product of polynomials over GF(2) modulo that of CRC-32, highest bit for the constant term."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def crc_before(crc: int, n_bytes: int) -> int:
    """What the CRC-32 of a piece adds (by exclusive or) to that of its text when n_bytes follow the piece."""
    power, factor = 1 << 23, 1 << 31  # x**8 and 1
    while n_bytes:
        if n_bytes & 1:
            factor = _product(power, factor)
        power, n_bytes = _product(power, power), n_bytes >> 1
    return _product(factor, crc)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    freq = frequencies(spark, folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Frequencies(freq)
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                part, rows = batch.slice(at, AT_ONCE), []
                meta = part.select(["shard", "first", "ids_crc", "doc_id", "doc_start", "begin", "after"]).to_pylist()
                for block, (_, ids) in zip(meta, _decoded(table, part)):
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    if zlib.crc32(raw) != block["ids_crc"]:
                        raise ValueError(f"ids from {block['first']} on don't fit their checksum")
                    ends = [*block["begin"][1:], len(ids)]
                    for doc, start, lo, hi, after in zip(block["doc_id"], block["doc_start"], block["begin"], ends, block["after"]):
                        crc = zlib.crc32(raw[4 * lo : 4 * hi])
                        rows.append((doc, block["shard"], start, hi - lo, crc_before(crc, 4 * after) if after else crc))
                columns = zip(*rows) if rows else [[]] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "shard", "at", "n", "crc"])

    pieces = spark.read.parquet(f"{folder}/blocks").mapInArrow(run, "doc_id long, shard int, at long, n long, crc long")
    whole = pieces.groupBy("shard", "at", "doc_id").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    shards = spark.read.parquet(f"{folder}/shards").withColumnRenamed("start", "before").select("shard", "before")
    return whole.join(shards, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """Positions [start, stop) of all ids: rows of a first position and the ids from there on, in order of position."""
    freq = frequencies(spark, folder)
    shards = spark.read.parquet(f"{folder}/shards").where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)).withColumnRenamed("start", "before")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Frequencies(freq)
        for batch in batches:
            for row in range(len(batch)):
                part = batch.slice(row, 1)
                before, first = part["before"][0].as_py(), part["first"][0].as_py()
                (at, ids), = _decoded(table, part, start - before, stop - before)
                a = max(start - before - first, 0)
                ids = ids[a - at : stop - before - first - at]
                yield pa.record_batch([pa.array([before + first + a]), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["position", "ids"])

    touched = spark.read.parquet(f"{folder}/blocks").join(shards.select("shard", "before"), "shard").where((F.col("before") + F.col("first") < stop) & (F.col("before") + F.col("first") + F.col("n_ids") > start))
    return touched.select("before", "first", "n_ids", "states", "places", "words", "bytes_crc").mapInArrow(run, "position long, ids array<long>").orderBy("position")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(spark, write_tokens(docs, vocabulary_path("word_bpe_49k.json"), 2))
