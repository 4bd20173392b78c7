"""Centroid clusters, token files and the Merkle manifest against plain brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from flowlake.llm import bpe, centroid_clusters, merkle, rans, ranks, token_files

DOC = "doc_id long, text string, lang string, source string, n_chars long, rank string, tree string, row string, shard string"


def docs(spark, rows):
    """rows of doc_id, text, source; other columns bear names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "en" if i != 3 else None, s, None if t is None else len(t), "r", "t", "w", "s") for i, t, s in rows], DOC)


# clusters


def plain_clusters(vectors, k, rounds, seed, dim):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], v) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    centroids = [r[1] for r in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v, _ in kept]
        for n in range(len(centroids)):
            if members := [v for (_, v, _), o in zip(kept, own) if o == n]:
                centroids[n] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *near(v)[::-1]) for i, v, _ in kept]
    total = {n: sum(d for _, c, d in found if c == n) for n in range(k)}
    digest = lambda n: hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()
    return sorted((str(i), c, d, total[c], sum(total.values()), digest(c)) for i, c, d in found)


def vectors(n=120, dim=6):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((4, dim)) * 3
    out = [(i, (centre[i % 4] + rng.standard_normal(dim) * 0.2).tolist()) for i in range(n)]
    out += [(i, out[0][1]) for i in range(200, 230)] + [(7, out[1][1]), (7, out[2][1]), (None, out[3][1]), (None, None)]
    return out + [(300, None), (301, []), (302, [1.0] * (dim - 1)), (303, [float("nan")] * dim), (304, [float("inf")] + [0.0] * (dim - 1)), (305, [None] + [0.0] * (dim - 1)), (306, [0.0] * dim)]


@pytest.mark.parametrize("k, rounds", [(8, 10), (3, 2), (500, 3)])
def test_clusters(spark, k, rounds):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance double")
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroid_clusters.cluster(df, 6, k, rounds).collect())
    assert got == plain_clusters(rows, k, rounds, 3, 6)


def test_clusters_of_nothing_and_of_equal_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroid_clusters.cluster(empty).count() == 0
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(20)], "vec_id long, embedding array<float>")
    assert {(r.cluster, r.distance, r.inertia) for r in centroid_clusters.cluster(same).collect()} == {(0, 0, 0)}


def test_clusters_refuse_what_a_long_does_not_hold(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a component exceeds"):
        centroid_clusters.cluster(df).collect()


def test_bounds_lie_below_and_spare_measurements():
    rng = np.random.default_rng(1)
    centre = rng.integers(-5000, 5000, (8, 64))
    x = centre[rng.integers(0, 8, 2000)] + rng.integers(-300, 300, (2000, 64))
    pivots, centroids = x[:8], centre
    away = np.sqrt(np.stack([centroid_clusters.squared(x, p) for p in pivots], axis=1))
    bounds = centroid_clusters.Bounds(pivots, centroids)
    true = np.sqrt(np.stack([centroid_clusters.squared(x, c) for c in centroids], axis=1))
    assert (bounds.below(away) <= true).all() and (bounds.below(away) > 0.3 * true).any()
    best, found, measured = centroid_clusters.nearest(x, away, centroids, bounds)
    assert np.array_equal(best, true.argmin(axis=1)) and np.array_equal(found, (true.min(axis=1) ** 2).round().astype(int)) and measured < 0.7 * true.size


# token files

TEXTS = [
    None, "", " \t\n", "Short TEXT, here!", "naïve 数据 ½ end's it's don't", "<|endoftext|> x <|startoftext|>", "a\x1cb\x85c d e", "ÀÉß ẞ İstanbul K Å ŸÿÞ", "...!!! ,x, x_y_z 3.14 é ́a",
    "w " * 20000, "x" * 70000, "Über-größe (quoted) `code` ~/path #tag @me $5 50%", "\n\n line one\r\nline two \x0b\x0c",
]


def plain_ids(text):
    own = bpe.tokenizer(bpe.vocabulary_path("word_bpe_49k.json"))
    return [*own.encode(text or "", add_special_tokens=False).ids, 2]


def files_of(spark, rows):
    return token_files.write_tokens(docs(spark, rows), bpe.vocabulary_path("word_bpe_49k.json"), 2)


def rows_of_all_kinds():
    rng = random.Random(2)
    words = ["".join(rng.choice(["an", "The", "é", "st", "o.", "Q"]) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(60)]
    rows = [(3 * i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    return rows + [(None, "no id", None), (None, "no id either", "s0"), (6, "twice", "s1"), (6, "twice", "s1"), (-5, "before all", "s0")]


@pytest.mark.parametrize("shard", [64 << 20, 20_000])
def test_files_give_back_every_document(spark, monkeypatch, shard):
    monkeypatch.setattr(token_files, "SHARD_BYTES", shard)
    rows = rows_of_all_kinds()
    got = token_files.read_documents(spark, files_of(spark, rows)).collect()
    ids = sorted(((i, x) for i, x in ((i, np.array(plain_ids(t), "<u4")) for i, t, _ in rows)), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), zlib.crc32(r[1])))
    want, start = [], 0
    for i, x in ids:
        want.append((i, start, len(x), zlib.crc32(x)))
        start += len(x)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_a_range_is_read_from_the_nearest_checkpoint(spark):
    rows = rows_of_all_kinds()
    folder = files_of(spark, rows)
    ids = np.concatenate([x for _, x in sorted(((i, np.array(plain_ids(t))) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), zlib.crc32(r[1].astype("<u4"))))])
    for a, b in ((0, 1), (17000, 40000), (len(ids) - 5, len(ids)), (0, len(ids)), (30, 30)):
        found = token_files.read_range(spark, folder, a, b).collect()
        assert [i for r in found for i in r.ids] == ids[a:b].tolist() and all(r.position >= a for r in found)


def test_a_changed_byte_is_found(spark):
    folder = files_of(spark, [(i, "some words to encode " * 30, "s") for i in range(20)])
    from pyspark.sql import functions as F

    spark.read.parquet(f"{folder}/blocks").withColumn("words", F.concat(F.expr("substring(words, 1, 9)"), F.unhex(F.lit("00")), F.expr("substring(words, 11)"))).write.parquet(f"{folder}-bad/blocks")
    for part in ("frequencies", "shards"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"{folder}-bad/{part}")
    with pytest.raises(Exception, match="doesn't fit its checksum"):
        token_files.read_documents(spark, f"{folder}-bad").collect()


def test_files_of_no_documents(spark):
    folder = files_of(spark, [])
    assert token_files.read_documents(spark, folder).count() == 0 and token_files.read_range(spark, folder, 0, 10).count() == 0


def test_rans_round_trip_and_size():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.01, 2 * token_files.BLOCK) - 1, 999).reshape(2, -1)
    table = rans.Frequencies.of_counts(np.bincount(ids.ravel(), minlength=1000))
    coded = rans.encode(table, ids)
    p = np.bincount(ids.ravel()) / ids.size
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * ids.size / 8
    assert sum(4 * len(words) for *_, words in coded) < 1.02 * entropy + 8 * 64
    for row, (states, places, words) in zip(ids, coded):
        out, last = rans.decode(table, states, places, words, rans.STEPS)
        assert np.array_equal(out.ravel(), row) and np.array_equal(last[:-1], states[1:]) and (last[-1] == 1 << 32).all()
    one = rans.Frequencies.of_counts(np.array([0, 7, 0]))
    (states, places, words), = rans.encode(one, np.ones((1, 128), int))
    assert (rans.decode(one, states, places, words, 2)[0] == 1).all()
    with pytest.raises(ValueError):
        rans.encode(one, np.zeros((1, 64), int))


def test_checksums_of_pieces_combine():
    raw = random.Random(4).randbytes(5000)
    for cut in (0, 1, 7, 4096, 4999):
        assert token_files.crc_before(zlib.crc32(raw[:cut]), 5000 - cut) ^ zlib.crc32(raw[cut:]) == zlib.crc32(raw)


def test_words_are_forgotten_beyond_the_limit():
    own = token_files.WordEncoder(bpe.vocabulary_path("word_bpe_49k.json"), limit=5)
    texts = ["one two three four five six", None, "seven one TWO, eight don't", "nine ten one"]
    for _ in range(3):
        assert [x.tolist() for x in own.encode(pa.array(texts))] == [plain_ids(t)[:-1] for t in texts]


# manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(level):
    """The root and for each leaf the runs that it and its ancestors stand in, with their places."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            paths[k].append((i % 3, level[i - i % 3 : i - i % 3 + 3]))
        at = [i // 3 for i in at]
        level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    key = lambda s: (s is not None, (s or "").encode())
    leaf = lambda r, text: plain_leaf(r[0], r[2], "en" if r[0] != 3 else None, None if r[1] is None else len(r[1]), text)
    sources = sorted({r[2] for r in rows}, key=key)
    trees, out = [], []
    for s in sources:
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((own, *plain_tree([leaf(r, r[1]) for r in own])))
    root, upper = plain_tree([t[1] for t in trees])
    for (own, subroot, lower), top in zip(trees, upper):
        for r, path in zip(own, lower):
            cut = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            found = leaf(r, r[1].replace("\n", "") if cut else r[1])
            for place, run in path + top:
                found = H(*run[:place], found, *run[place + 1 :])
            beside = [x for place, run in path + top for k, x in enumerate(run) if k != place]
            out.append((r[0], leaf(r, r[1]), subroot, root, H(*beside), found, found == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, merkle.BAND])
def test_manifest(spark, height):
    rows = [(i, f"text {i}\nwith lines\n" if i % 3 else f"text {i}", "hot") for i in range(100)]
    rows += [(i, "é\n" * i, s) for i, s in enumerate(["b", None, "B", "é", "\U0001f600", "ab", "", None, "b", "￿"])]
    rows += [(None, "a\nb", "b"), (None, None, None), (7, "again\n", "hot"), (7, "again\n", "hot"), (5, None, "lone"), (8, "\n" * 5000 + "x" * 200000, "long")]
    got = merkle.manifest(docs(spark, rows), height).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "x\ny", "s") for i in range(n)]
    assert sorted(map(tuple, merkle.manifest(docs(spark, rows)).collect()), key=str) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(docs(spark, [])).collect() == []


def test_running_start_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(ranks, "GROUP", 4)
    df = spark.createDataFrame([(k, i, i + 1) for k in ("a", None) for i in range(23)], "k string, i int, n int")
    got = {(r.k, r.i): r.start for r in ranks.running_start(df, ["k"], "i", "n").collect()}
    assert got == {(k, i): i * (i + 1) // 2 for k in ("a", None) for i in range(23)}
