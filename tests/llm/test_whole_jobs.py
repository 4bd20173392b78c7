"""Operators do the whole job: cases in which an earlier version did less."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from flowlake.llm import blocks, bpe, lm_score, ngram_join, substring_dedup, topk


def test_op4_keeps_its_classes_and_context():
    _, first, context = lm_score.windows(np.array([99]))
    assert lm_score.CLASSES >= 128 and len(first) > 1 and all(context[1:] >= 8)


def test_op4_learns_from_all_training_documents(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"alpha beta word{i} gamma") for i in range(1000)], "doc_id long, text string")
    passed = []
    rounds = lm_score.train_blocks
    monkeypatch.setattr(lm_score, "train_blocks", lambda model, texts, *a: passed.append(texts) or rounds(model, texts, *a))
    out = lm_score.score(df).toPandas()
    learned = [r.doc_id[i] for r in passed[0].collect() for k in range(lm_score.ROUNDS) for i in lm_score.Block(r.asDict(), np.uint16).learning(k)]
    assert sorted(learned) == sorted(out.doc_id[~out.held_out]) and len(learned) > 850


def block_row(b, texts):
    """A row of texts of ids, each id a word."""
    ids = np.unique(np.concatenate(texts))
    parts = [np.int64([len(ids), len(ids)]), np.ones(len(ids), np.int64), np.ones(len(ids), np.uint32), ids.astype(np.uint16)]
    parts += [np.append(np.searchsorted(ids, t), 0).astype(np.uint32) for t in texts]
    return (b, [0] * len(texts), [False] * len(texts), [len(t) + 1 for t in texts], 0, 0, zstandard.compress(b"".join(x.tobytes() for x in parts)))


def test_op4_rounds_over_blocks_give_the_mean_of_their_passes(spark):
    rng, end = np.random.default_rng(1), 11
    counts = np.arange(12, 0, -1).astype(float)
    blocks = [[rng.integers(0, 8 + 3 * b, 40).astype(np.int32) for _ in range(4)] for b in range(2)]
    rows = [block_row(b, t) for b, t in enumerate(blocks)]
    got = lm_score.train_blocks(lm_score.Model(counts), spark.createDataFrame(rows, lm_score._TEXTS), end, np.uint16)
    want, state = lm_score.Model(counts), {c: np.full_like(x, 1e-8) for c, x in lm_score.Model(counts).p.items()}
    for k in range(lm_score.ROUNDS):
        done = []
        for t in blocks:
            m, s = lm_score.Model(counts), {c: x.copy() for c, x in state.items()}
            m.p = {c: x.copy() for c, x in want.p.items()}
            texts = [np.concatenate([[end], x, [end]]).astype(np.int32) for i, x in enumerate(t) if i % lm_score.ROUNDS == k]
            lm_score.learn(m, texts, s, k, lm_score.ROUNDS)
            done.append((m.p, s, np.unique(np.concatenate([x[:-1] for x in texts])), sum(len(x) - 1 for x in texts)))
        weight = np.array([d[3] for d in done], float)
        for c in want.p:
            for old, i in ((want.p, 0), (state, 1)):
                if c != "emb":
                    old[c] = sum(d[i][c] * w for d, w in zip(done, weight)) / weight.sum()
                else:
                    for v in range(12):
                        own = [(d[i][c][v], d[3]) for d in done if v in d[2]]
                        old[c][v] = sum(x * w for x, w in own) / sum(w for _, w in own) if own else old[c][v]
    assert all(np.allclose(got.p[c], want.p[c], atol=1e-3) for c in want.p)


def slow_log_next(model, ids, at, first):
    """Natural log probabilities at place ``at`` of each id as the next, and of a word's beginning, by plain loops from ``first``."""
    p, d = model.p, lm_score.DIM
    x = [p["emb"][ids[t]].astype(float) + p["pos"][t - first] for t in range(first, at + 1)]
    q, k, v = x[-1] @ p["qkv"][:, :d], [y @ p["qkv"][:, d : 2 * d] for y in x], [y @ p["qkv"][:, 2 * d :] for y in x]
    w = [math.exp(q @ y / math.sqrt(d)) for y in k]
    h = x[-1] + (sum(a * y for a, y in zip(w, v)) / sum(w)) @ p["o"]
    z, g = h @ p["out"] + p["bias"], lm_score.GROUPS
    groups = np.exp(z[:g]) / np.exp(z[:g]).sum()
    classes = np.exp(z[g:] + p["pair"])
    classes /= classes.sum(axis=1, keepdims=True)
    log = np.log((groups[:, None] * classes).ravel()[model.cls]) + model.within
    return log, math.log(groups[: g // 2].sum())


def test_op4_score_equals_plain_loops(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = ["river", "Stone", "unbelievably", "ox", "zzyzx", "the", "naïve", "x.y-z"]
    rows = [(i, " ".join(rng.choice(vocabulary, 60 if i == 10 else 6))) for i in range(30)] + [(40, None), (None, "river ox")]
    got, kept = [], []
    rounds = lm_score.train_blocks
    monkeypatch.setattr(lm_score, "train_blocks", lambda *a: kept.append(rounds(*a)) or kept[0])
    got = {(r.doc_id): r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    model, path = kept[0], lm_score.vocabulary_path("byte_bpe_50k.json")
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    lower = {i: (t or "").lower().split() for i, t in rows}
    counts = Counter(w for i, ws in lower.items() if not held[i] for w in [*ws, None])
    total = sum(counts.values())
    step = lm_score.WINDOW - lm_score.OVERLAP
    for doc in (0, 10, 17, 40, None):
        want, ids, sizes = 0.0, [50256], []
        for w in lower[doc]:
            own = lm_score.ids_of_words(path, [w.encode()])[0]
            ids, sizes = ids + own, [*sizes, len(own)]
        ids, at = [*ids, 50256], 0
        places = [slow_log_next(model, ids, t, max(0, (t - lm_score.OVERLAP) // step) * step) for t in range(len(ids) - 1)]
        assert all(abs(np.exp(log).sum() - 1) < 1e-4 for log, _ in places)
        for w, size in zip([*lower[doc], None], [*sizes, 1]):
            own = sum(places[at + j][0][ids[at + j + 1]] for j in range(size)) - places[at][1]
            if w is not None:
                own += places[at + size][1]
            known = (counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))
            want += math.log10(lm_score.MIX * known + (1 - lm_score.MIX) * math.exp(own))
            at += size
        assert got[doc].score == pytest.approx(want, rel=1e-4)


def test_op4_scores_held_out_text_above_the_word_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lm_score.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_op5_repeated_query_rows_are_queries_each(spark):
    rng = np.random.default_rng(4)
    draw = lambda n=8: [float(np.float32(x)) for x in rng.normal(size=n)]
    rows = [(i, draw()) for i in range(1, 60)] + [(7, draw()), (8, draw(6)), (9, draw(6))]
    same, other = draw(), draw()
    rows += [(100, same), (100, same), (200, other), (200, draw()), (300, draw()), (300, draw(6)), (400, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 100 == 0).collect())
    with duckdb.connect() as con:
        con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
        con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
        assert got == sorted(con.execute(topk.ORACLE).fetchall())
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    for q in (100, 200, 300, 400):
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for p, v in ints if p == q for i, w in ints if i != q and len(v) == len(w))[:10]
        assert [(r[1], r[2], r[3]) for r in got if r[0] == q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_op10_all_texts_of_one_id_link(spark):
    rng = np.random.default_rng(6)
    draw = lambda: [f"w{i}" for i in rng.integers(0, 10**6, 60)]
    near = lambda t: " ".join([*t[:-1], "other"])
    rows, want = [], {}
    for k in range(12):  # id 10 k has two texts; each has a near copy, and the second an exact copy under a smaller id
        a, b = draw(), draw()
        rows += [(10 * k + 5, " ".join(a)), (10 * k + 5, " ".join(b)), (10 * k + 6, near(a)), (10 * k + 7, near(b))]
        want |= {10 * k + 5: 10 * k + 5, 10 * k + 6: 10 * k + 5, 10 * k + 7: 10 * k + 5}
        if k % 2:
            rows.append((10 * k + 3, " ".join(b)))
            want = {i: 10 * k + 3 if i // 10 == k else c for i, c in want.items()} | {10 * k + 3: 10 * k + 3}
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == set(want.items())


def test_payloads_through_districts_give_the_same_answers(spark, monkeypatch):
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i if i % 7 else None, " ".join(f"w{j}" for j in rng.integers(0, 300, 200)) + (" " + passage if i % 5 == 0 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = lm_score.vocabulary_path("word_bpe_49k.json")
    run = lambda: [sorted(map(str, f(df).collect())) for f in (substring_dedup.drop_repeated_windows, lambda d: bpe.encode(d, path))]
    direct = run()
    monkeypatch.setattr(blocks, "DIRECT", 1)
    monkeypatch.setattr(blocks, "block_count", lambda *a: 7)
    assert run() == direct
