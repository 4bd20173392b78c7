"""Substring dedup: level-wise doubling of repeated word windows.

The levels are window lengths, each at most twice the one before, the last the wanted length. A window can only be
repeated if its parts are, so at the first level each window of the second level's length is stood for by the smallest hash
among its parts of ``first_words`` words: equal windows have equal smallest parts, and neighbours mostly share theirs, so
that about a tenth of all parts is counted over the whole corpus (block exchange of packed 32-bit fingerprints, which can
only keep too many). Windows all of whose parts are repeated are extended to about twice the length and alone counted
at the next level, by 128-bit hashes, until the wanted length is reached or no candidates survive: a document without one
is done at once. The removal covers words of windows of the wanted length, so longer ones need no counting: each word of
theirs lies in one of these. Words covered by a repeated window are removed in every place where it occurs.

Defined results: null text counts as empty; a text with fewer words than the window keeps everything; windows
never cross documents; rows with equal or null doc_id are separate documents; other columns are ignored; an
empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm import blocks as B
from flowlake.llm.words import KEY, mix, sliding_min, window_hashes, word_hashes
from flowlake.tables import materialize

WINDOW = 35
SOME = 1 << 18  # windows whose hashes are held at once
_KINDS = "kind string, block int, bucket int, payload binary, doc_id long, n_words long, n_removed long, text string, kept string"
_SCHEMA = pa.schema([("kind", pa.string()), ("block", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("kept", pa.string())])


def levels(window: int, first_words: int) -> list[int]:
    """Window lengths of the levels: the last is window, each at most twice the one before."""
    out = [window]
    while out[0] > first_words:
        out.insert(0, -(-out[0] // 2))
    return out


def _concat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket in the high and a 32-bit fingerprint in the low half."""
    return ((hashes >> np.uint64(32)) % np.uint64(n)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def _first_keys(words: np.ndarray, size: int, to: int, n: int) -> np.ndarray:
    """The keys that stand for a document's windows of ``to`` words: the smallest hash of the windows of ``size`` words in each."""
    return _keys(sliding_min(window_hashes(words, size), to - size + 1), n)


def _distinct_first(words: list[np.ndarray], size: int, to: int, n: int) -> np.ndarray:
    """The block's distinct first keys; a document's are made distinct before the next one's are made."""
    return np.unique(_concat([np.unique(_first_keys(w, size, to, n)) for w in words]))


def _counted(keys: np.ndarray, words: list[np.ndarray], size: int, n: int) -> np.ndarray:
    """How often each of the sorted keys occurs among all windows of ``size`` words, some documents at a time."""
    counts, some, held = np.zeros(len(keys) + 1, np.int64), [], 0
    for i, w in enumerate(words):
        some.append(window_hashes(w, size))
        held += len(some[-1])
        if held >= SOME or i + 1 == len(words):
            part, many = np.unique(_keys(_concat(some), n), return_counts=True)
            at = np.searchsorted(keys, part)
            at[keys[np.minimum(at, len(keys) - 1)] != part] = len(keys)  # none of these
            np.add.at(counts, at, many)
            some, held = [], 0
    return counts[:-1]


def _ask_first(size: int, to: int, n: int):
    def ask(table: pa.Table) -> pa.Table:
        keys = _distinct_first(_words(table), size, to, n)
        at = B.bucket_offsets(keys >> np.uint64(32), n)
        low = keys.astype(np.uint32)
        return B.payload_table(table["block"][0].as_py(), ((k, low[at[k] : at[k + 1]].tobytes()) for k in range(n)))

    return ask


def _answer(dtype):
    def answer(table: pa.Table) -> pa.Table:
        """For each block's distinct keys a bit: some other block has the key too."""
        asked = [np.frombuffer(p, dtype) for p in B.payloads(table)]
        every, inverse, counts = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        many, at = (counts > 1)[inverse], np.concatenate([[0], np.cumsum([len(a) for a in asked])])
        return B.answers_table(table, [np.packbits(many[at[i] : at[i + 1]]).tobytes() for i in range(len(asked))])

    return answer


def _flags(bucket: np.ndarray, n: int, answers: pa.Table) -> np.ndarray:
    """Bits of the answers, in the order of the block's distinct keys sorted by bucket."""
    at = B.bucket_offsets(bucket, n)
    out = np.zeros(len(bucket), bool)
    for k, bits in B.by_bucket(answers).items():
        out[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=at[k + 1] - at[k])
    return out


def _kept(text: str | None, covered: np.ndarray | None, digest: bool) -> str:
    words = (text or "").encode().split()
    if covered is not None:
        words = [w for w, gone in zip(words, covered) if not gone]
    kept = b" ".join(words)
    return hashlib.sha256(kept).hexdigest() if digest else kept.decode()


def _cover(positions: np.ndarray, size: int, n_words: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, positions, 1)
    np.add.at(edge, positions + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _rows(rows: list[tuple], table: pa.Table) -> pa.Table:
    schema = _SCHEMA.append(table.schema.field("rest"))
    return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _wide(words: np.ndarray, size: int, mask: np.ndarray) -> np.ndarray:
    """128-bit hashes of the windows of ``size`` words at the places of mask."""
    out = np.zeros(int(mask.sum()), KEY)
    out["hi"], out["lo"] = (window_hashes(w, size)[mask] for w in (words, mix(words)))
    return out


def _distinct(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys sorted by bucket, their buckets, for each key the place of its own, and their counts."""
    bucket = (keys["hi"] >> np.uint64(32)) % np.uint64(n)
    order = np.lexsort((keys["lo"], keys["hi"], bucket))
    own = keys[order]
    first = np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    inverse = np.zeros(len(own), np.int64)
    inverse[order] = np.cumsum(first) - 1
    return own[first], bucket[order][first], inverse, np.bincount(inverse, minlength=int(first.sum()))


def _next_requests(block: int, candidates: list[np.ndarray], n: int) -> list[tuple]:
    """The distinct hashes of the candidate windows, for their buckets."""
    if not candidates:
        return []
    keys, bucket, _, _ = _distinct(np.concatenate(candidates), n)
    at = B.bucket_offsets(bucket, n)
    return [("ask", block, k, keys[at[k] : at[k + 1]].tobytes(), None, None, None, None, None, None) for k in range(n) if at[k + 1] > at[k]]


def _open(block: int, doc, n_words: int, text, mask: np.ndarray, rest) -> tuple:
    return ("open", block, None, np.packbits(mask).tobytes(), doc, n_words, None, text, None, rest)


def _done(block: int, doc, n_words: int, text, covered: np.ndarray | None, digest: bool, rest) -> tuple:
    return ("done", block, None, None, doc, n_words, 0 if covered is None else int(covered.sum()), None, _kept(text, covered, digest), rest)


def _words(table: pa.Table) -> list[np.ndarray]:
    words, offsets = word_hashes(table["text"], lower=False)
    return [words[offsets[i] : offsets[i + 1]] for i in range(len(offsets) - 1)]


def _close(table: pa.Table, masks: list[np.ndarray], n_words: list[int], found: Callable, n: int, digest: bool) -> pa.Table:
    """Documents whose masks are empty are done; the others stay open, with requests for what ``found`` gives of each."""
    block, out, wanted = table["block"][0].as_py(), [], []
    for i, (doc, text, rest) in enumerate(zip(table["doc_id"].to_pylist(), table["text"], table["rest"].to_pylist())):
        if masks[i].any():
            wanted.append(found(i))
            out.append(_open(block, doc, int(n_words[i]), text.as_py(), masks[i], rest))
        else:
            out.append(_done(block, doc, int(n_words[i]), text.as_py(), None, digest, rest))
    return _rows(out + _next_requests(block, wanted, n), table)


def _finish_first(window: int, size: int, to: int, n: int, digest: bool):
    """Masks of the windows of ``window`` words of which every part of ``to`` words holds a repeated part of ``size`` words."""

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _rows([], table)
        words = _words(table)
        keys = _distinct_first(words, size, to, n)
        repeated = _flags(keys >> np.uint64(32), n, answers)
        if len(keys):  # a part repeated in the block itself counts
            repeated |= _counted(keys, words, size, n) > 1
        masks = [sliding_min(repeated[np.searchsorted(keys, _first_keys(w, size, to, n))], window - to + 1) for w in words]
        n_words = [len(w) for w in words]
        return _close(table, masks, n_words, lambda i: _wide(words[i], to, _spread(masks[i], window - to)), n, digest)

    return finish


def _spread(mask: np.ndarray, more: int) -> np.ndarray:
    """Places of the parts of the windows of mask, which begin at most ``more`` words later."""
    edge = np.zeros(len(mask) + more + 1, np.int64)
    at = np.flatnonzero(mask)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + more + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _finish_next(window: int, size: int, to: int, n: int, digest: bool):
    """Answers on the parts of ``size`` words of the open windows; those of which all are repeated ask about parts of ``to``
    words, or, with size the window, cover."""

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _rows([], table)
        words, n_words = _words(table), table["n_words"].to_pylist()
        masks = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(w) - window + 1).astype(bool) for b, w in zip(B.payloads(table), words)]
        asked = [_spread(m, window - size) for m in masks]
        _, bucket, inverse, counts = _distinct(np.concatenate([_wide(w, size, a) for w, a in zip(words, asked)]), n)
        repeated, at = (_flags(bucket, n, answers) | (counts > 1))[inverse], 0
        for i, a in enumerate(asked):
            some = int(a.sum())
            a[a] = repeated[at : at + some]
            at += some
            masks[i] = masks[i] & sliding_min(a, window - size + 1)
        if size < window:
            return _close(table, masks, n_words, lambda i: _wide(words[i], to, _spread(masks[i], window - to)), n, digest)
        block, rows = table["block"][0].as_py(), zip(table["doc_id"].to_pylist(), n_words, table["text"], masks, table["rest"].to_pylist())
        return _rows([_done(block, doc, k, text.as_py(), _cover(np.flatnonzero(m), size, k) if m.any() else None, digest, rest) for doc, k, text, m, rest in rows], table)

    return finish


def drop_repeated_windows(docs: DataFrame, window: int = WINDOW, first_words: int = 18, digest: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``: the kept words joined by one space, or with digest their SHA-256;
    then the columns to keep."""
    n = B.block_count(docs)
    buckets, sizes = B.bucket_count(n), levels(window, first_words)
    blocks = B.with_block(docs, n, keep)
    schema = B.schema_with_rest(_KINDS, blocks)
    to = sizes[min(1, len(sizes) - 1)]
    state = materialize(B.exchange(blocks, _ask_first(sizes[0], to, buckets), _answer(np.uint32), _finish_first(window, sizes[0], to, buckets, digest), schema, n), "windows")
    out = state.where("kind = 'done'")
    for size, to in zip(sizes[1:] or sizes, [*sizes[2:], 0]):
        opened = state.where("kind = 'open'").select("block", "doc_id", "n_words", "text", "payload", "rest")
        asked = state.where("kind = 'ask'").select("block", "bucket", "payload")
        answered = B.answered(asked, _answer(KEY), n)
        state = opened.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(B.released(_finish_next(window, size, to, buckets, digest)), schema)
        if to:
            state = materialize(state, "windows")
        out = out.unionByName(state.where("kind = 'done'"))
    return B.with_rest(out.select("doc_id", "n_words", "n_removed", "kept", "rest"), keep)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = drop_repeated_windows(docs, digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT row, w, unnest(range(1, len(w) - 33)) AS pos FROM docs WHERE len(w) >= 35),
hashed AS (SELECT row, pos, md5(array_to_string(list_slice(w, pos, pos + 34), ' ')) AS key FROM starts),
hits AS (SELECT row, pos FROM hashed SEMI JOIN (SELECT key FROM hashed GROUP BY key HAVING count(*) > 1) USING (key)),
gone AS (SELECT DISTINCT row, unnest(range(pos, pos + 35)) AS pos FROM hits),
covered AS (SELECT row, list(pos) AS gone FROM gone GROUP BY row),
flat AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
left_over AS (SELECT row, string_agg(word, ' ' ORDER BY pos) AS kept FROM flat ANTI JOIN gone USING (row, pos) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN covered USING (row) LEFT JOIN left_over USING (row)
"""
