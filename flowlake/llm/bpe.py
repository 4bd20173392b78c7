"""BPE encoding and decoding through a table of distinct words.

Spark splits the texts at ``[\\x20\\x09-\\x0D]`` into words. Blocks of documents send their distinct words, sorted and
compressed, to hash buckets; a bucket encodes each distinct word of the corpus once and answers with the ids in the
same order. Every document then takes the ids of its words by position, and decodes by looking each id up in the
vocabulary's id-to-piece table (its size is the vocabulary's, whatever the corpus). This holds for tokenizers that
drop white space and never merge across it, as ``word_bpe_49k.json``; ``splits_at_spaces`` checks it.

Defined results: null text encodes as empty text, to no ids; special tokens' strings in a text give their ids; rows
with equal or null doc_id are separate documents; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from flowlake.llm import blocks as B

BATCH, BLOCK_BYTES = 20_000, 20 << 20
_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_loaded: dict[str, object] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The tokenizer of the file, without truncation or padding; one for each worker process."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _loaded[path] = made
    return _loaded[path]


def splits_at_spaces(path: str) -> bool:
    """Whether the file drops white space between words and its decoder joins pieces by one space."""
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    steps = (kind["pre_tokenizer"] or {}).get("pretokenizers", [])
    return kind["decoder"] is None and any(s["type"] == "Split" and s["behavior"] == "Removed" for s in steps)


def pieces(path: str) -> list[str]:
    """The id-to-piece table."""
    if f"{path} pieces" not in _loaded:
        own = tokenizer(path)
        _loaded[f"{path} pieces"] = [own.id_to_token(i) for i in range(own.get_vocab_size())]
    return _loaded[f"{path} pieces"]


def id_type(path: str):
    return np.uint16 if tokenizer(path).get_vocab_size() <= 1 << 16 else np.uint32


def encode_words(path: str, words: list[bytes]) -> list[list[int]]:
    out = []
    for i in range(0, len(words), BATCH):
        batch = [w.decode() for w in words[i : i + BATCH]]
        out += [e.ids for e in tokenizer(path).encode_batch_fast(batch, add_special_tokens=False)]
    return out


def _by_bucket(words: set[bytes], n: int) -> list[list[bytes]]:
    out: list[list[bytes]] = [[] for _ in range(n)]
    for w in words:
        out[zlib.crc32(w) % n].append(w)
    for part in out:
        part.sort()
    return out


def _distinct(table: pa.Table) -> set[bytes]:
    words: set[bytes] = set()
    for text in table["text"]:
        if text.is_valid:
            words.update(text.as_py().encode().split())
    return words


def _ask(n: int):
    def ask(table: pa.Table) -> pa.Table:
        pack = zstandard.ZstdCompressor(level=9)
        return B.payload_table(table["block"][0].as_py(), ((k, pack.compress(b"\n".join(part))) for k, part in enumerate(_by_bucket(_distinct(table), n)) if part))

    return ask


def _answer(path: str):
    def answer(table: pa.Table) -> pa.Table:
        """For each block's words the number of ids of each, then all ids."""
        asked = [zstandard.decompress(p).split(b"\n") for p in B.payloads(table)]
        words = sorted(set().union(*asked))
        place = dict(zip(words, range(len(words))))
        ids = encode_words(path, words)
        kind = id_type(path)
        size = np.array([len(x) for x in ids], np.uint32)
        at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        flat = np.fromiter((i for x in ids for i in x), kind, int(at[-1]))
        pack, out = zstandard.ZstdCompressor(level=9), []
        for part in asked:
            own = np.fromiter(map(place.__getitem__, part), np.int64, len(part))
            count = size[own]
            take = np.repeat(at[own] - np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count) + np.arange(int(count.sum()))
            out.append(pack.compress(count.tobytes() + flat[take].tobytes()))
        return B.answers_table(table, out)

    return answer


def _finish(path: str, n: int, digest: bool):
    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        parts, piece = _by_bucket(_distinct(table), n), pieces(path)
        number = [str(i) for i in range(len(piece))]
        ids_of: dict[bytes, str] = {}
        text_of: dict[bytes, str] = {}
        for k, payload in zip(answers["bucket"].to_pylist(), B.payloads(answers)):
            raw = zstandard.decompress(payload)
            count = np.frombuffer(raw, np.uint32, len(parts[k]))
            ids, at = np.frombuffer(raw, id_type(path), -1, 4 * len(count)).tolist(), 0
            for word, size in zip(parts[k], count.tolist()):
                own = ids[at : at + size]
                at += size
                ids_of[word], text_of[word] = " ".join([number[i] for i in own]), " ".join([piece[i] for i in own])
        blank = {w for w, x in ids_of.items() if not x}
        rows = []
        for doc, text in zip(table["doc_id"].to_pylist(), table["text"]):
            words = (text.as_py() or "").encode().split()
            if blank:
                words = [w for w in words if w not in blank]
            ids, decoded = " ".join(map(ids_of.__getitem__, words)), " ".join(map(text_of.__getitem__, words))
            size = ids.count(" ") + 1 if ids else 0
            if digest:
                rows.append((doc, size, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            else:
                rows.append((doc, size, [int(i) for i in ids.split()], decoded))
        schema = _DIGESTS if digest else _IDS
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()

    return finish


def encode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text; with digest the SHA-256 of the decimal ids joined by one space
    and of the decoded text instead."""
    if not splits_at_spaces(path):
        raise ValueError("the tokenizer must drop white space and join pieces by one space")
    n = B.block_count(docs, BLOCK_BYTES)
    buckets = B.bucket_count(n)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, n_tokens long, ids array<int>, decoded string"
    return B.exchange(B.with_block(docs, n), _ask(buckets), _answer(path), _finish(path, buckets, digest), schema, n)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("word_bpe_49k.json"), digest=True)
