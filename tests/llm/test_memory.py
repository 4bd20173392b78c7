"""Blocks and buckets count their keys some at a time."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard

from flowlake.llm import blocks, ngram_join, substring_dedup


def peak_of(work, *args):
    tracemalloc.start()
    out = work(*args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def asked(lows, counts):
    pack = zstandard.ZstdCompressor(level=1)
    rows = [np.uint32(len(x)).tobytes() + x.tobytes() + pack.compress(c.tobytes()) for x, c in zip(lows, counts)]
    return pa.table([pa.array(range(len(rows)), pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array(rows, pa.binary())], schema=blocks._PAYLOAD)


def test_op10_buckets_count_by_slices():
    """All keys of a bucket were sorted at once, with six arrays of their length."""
    rng = np.random.default_rng(1)
    lows = [np.unique(rng.integers(0, 1 << 32, 150_000, dtype=np.uint64).astype(np.uint32) // np.uint32(3000) * np.uint32(3000)) for _ in range(8)] + [np.array([5], np.uint32), np.array([0, (1 << 32) - 1], np.uint32)]
    counts = [rng.integers(1, 5, len(x)).astype(np.uint32) for x in lows]
    want = Counter()
    for x, c in zip(lows, counts):
        want.update(dict(zip(x.tolist(), c.tolist())))
    table = asked(lows, counts)
    got, peak = peak_of(ngram_join._answer, table)
    for x, p in zip(lows, blocks.payloads(got)):
        assert np.frombuffer(zstandard.decompress(p), np.uint32).tolist() == [want[k] for k in x.tolist()]
    assert sum(map(len, lows)) > 2 * ngram_join.SLICE and peak < 32 * sum(map(len, lows))


def test_op8_counts_windows_of_some_documents_at_a_time(monkeypatch):
    """A block held and sorted the hashes of all its windows, twice."""
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 3, n).astype(np.uint64) for n in (5, 40, 0, 700, 17, 300)]
    plain = Counter(int(k) for w in words for k in substring_dedup._keys(substring_dedup.window_hashes(w, 4), 3))
    keys = substring_dedup._distinct_first(words, 4, 9, 3)
    sizes = []
    concat = substring_dedup._concat
    monkeypatch.setattr(substring_dedup, "_concat", lambda parts: sizes.append(len(parts)) or concat(parts))
    monkeypatch.setattr(substring_dedup, "SOME", 50)
    assert substring_dedup._counted(keys, words, 4, 3).tolist() == [plain[k] for k in keys.tolist()]
    assert len(keys) and max(sizes) < len(words)


def test_workers_give_memory_back_behind_each_group(monkeypatch):
    """Each worker kept the peak of every stage of the pipeline."""
    given = []
    monkeypatch.setattr(blocks, "give_back", lambda: given.append(1))
    table = pa.table({"a": [1]})
    assert blocks.released(lambda t: t)(table) is table and blocks.released(lambda t, u: u)(None, table) is table and given == [1, 1]
