"""Quality classifier: supervised subword embeddings.

A document's features are its hashed words and character n-grams of the lengths ``GRAMS`` (over code points). Each feature has a learned vector; a document is the mean of its features' vectors, and a linear layer with a
softmax over the two labels gives the score. Training is stochastic gradient descent in numpy on at most ``SAMPLE`` labelled
documents (those with the smallest hash of the id, whole texts). The layer is linear in the mean, so scoring needs one
number a feature, the difference of the two outputs: a table of constant size that every task holds, applied to all of every text.

Defined results: null or empty text has no features and gets the score of the bias alone; without labelled rows every
score is 0.5; labels with a null or other value than 0 and 1 are left out, of several for one doc_id the highest counts; of
several texts under one labelled doc_id the one with the smallest hash is learned; rows with equal or null doc_id are
scored each on its own (a null id has a null held_out); other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.words import CHUNK, text_buffer, word_hashes

BUCKETS, DIM, SAMPLE, EPOCHS, RATE, SEED = 1 << 18, 8, 3000, 6, 0.5, 7
GRAMS, LABELS = (3, 4, 5), 2


def _grams(points: np.ndarray, size: int) -> np.ndarray:
    """Buckets of all runs of so many code points."""
    h = np.full(max(len(points) - size + 1, 0), size, np.uint64)
    for i in range(size):
        h = (h ^ points[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(BUCKETS)).astype(np.int32)


def _points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode().encode("utf-32-le"), np.uint32).astype(np.uint64)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of one text and how often each occurs."""
    words, _ = word_hashes(pa.array([text]), lower=False)
    points = _points(text.encode())
    return np.unique(np.concatenate([(words % np.uint64(BUCKETS)).astype(np.int32), *(_grams(points, n) for n in GRAMS)]), return_counts=True)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """A weight for each bucket and a bias: the log odds of label 1 are the mean weight of the features plus bias."""
    rng = np.random.default_rng(SEED)
    if not texts:
        return np.zeros(BUCKETS, np.float32), 0.0
    rows = []
    for text in texts:
        at, count = features(text)
        rows.append((at, (count / max(count.sum(), 1)).astype(np.float32)[:, None]))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.uniform(-1 / DIM, 1 / DIM, (DIM, LABELS)).astype(np.float32), np.zeros(LABELS, np.float32)
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            lr = rate * (1 - step / steps)
            step += 1
            at, share = rows[i]
            mean = (vectors[at] * share).sum(axis=0)
            z = np.exp(mean @ out + bias - (mean @ out + bias).max())
            slope = -z / z.sum()
            slope[labels[i]] += 1
            ahead = out @ slope
            out += lr * np.outer(mean, slope)
            bias += lr * 0.1 * slope
            vectors[at] += (lr * len(at) ** 0.5) * share * ahead
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return run[np.maximum(ends, starts)] - run[starts]


def score_texts(column: pa.Array, weight: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for every text of the column."""
    data, _ = text_buffer(column)
    words, at = word_hashes(column, lower=False)
    low, high = at[:-1], at[1:]
    sums = _sums(weight[(words % np.uint64(BUCKETS)).astype(np.int32)], low, high)
    n = np.diff(at)
    lengths = np.array([len(x.as_py() or "") for x in column], np.int64)
    ends = np.cumsum(lengths)
    points = _points(data.tobytes())
    for size in GRAMS:
        n = n + np.maximum(lengths - size + 1, 0)
        for begin in range(0, max(len(points) - size + 1, 0), CHUNK):
            part = weight[_grams(points[begin : begin + CHUNK + size - 1], size)]
            clip = lambda x: np.clip(x - begin, 0, len(part))  # noqa: E731, B023
            sums += _sums(part, clip(ends - lengths), clip(np.maximum(ends - size + 1, ends - lengths)))
    return 1 / (1 + np.exp(-(sums / np.maximum(n, 1) + bias)))


def _score(weight: np.ndarray, bias: float, columns: list[str]):
    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                scores = pa.array(score_texts(part["text"], weight, bias), pa.float64())
                yield pa.record_batch([*(part[c] for c in columns), scores], names=[*columns, "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on at most ``sample`` labelled documents for which held_out (a column of doc_id) is false."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()  # at most sample rows
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] or "" for r in rows], [r["quality"] for r in rows])


def held_out(modulus: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest


def score_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every document with its score; learned from rows that are not held out."""
    weight, bias = fit(docs, labels, held_out(3, 1))
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_score(weight, bias, list(keep)), schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_quality(docs, labels)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
