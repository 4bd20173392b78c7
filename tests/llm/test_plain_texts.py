"""Plain texts are encoded whole, others by their units; both as the tokenizers library does."""

import pyarrow as pa

from flowlake.llm import packing as P
from flowlake.llm.bpe import tokenizer, vocabulary_path

TEXTS = ["a plain text", " two  spaces\n\n and lines \n", "it's 12,5 été škoda", "", None, "odd 世界 here", "<|endoftext|> a", "tab\tinside a", "x" * 3000, " ", "\n a"]


def test_ids_of_whole_texts():
    path, ranks = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken")
    batch = pa.record_batch([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS)], names=["doc_id", "text"])
    rows = pa.Table.from_batches(P._tokenize(path, 1 << 20, 0, True, ranks)([batch])).to_pylist()
    assert [r["ids"] for r in rows] == [[*tokenizer(path).encode(t or "", add_special_tokens=False).ids, 0] for t in TEXTS]


def test_plain_texts_leave_the_cache_empty(monkeypatch):
    """Each distinct word of each task went through the cache, and most words of a corpus are rare."""
    path, ranks = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken")
    asked = []
    monkeypatch.setattr(P.UnitCache, "add", lambda self, wanted: asked.append(wanted))
    batch = pa.record_batch([pa.array([1], pa.int64()), pa.array(["only plain words"])], names=["doc_id", "text"])
    assert len(list(P._tokenize(path, 2048, 0, False, ranks)([batch]))[0]) == 1 and asked == [set()]
