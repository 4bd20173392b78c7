"""Every operator against brute force, on texts with nulls, ties, copies, long and empty rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.llm import bpe, embedding_dedup, license, line_dedup, lm_score, ngram_join, packing, quality, substring_dedup, topk
from flowlake.llm.components import connected_components
from flowlake.llm.words import KEY

DOC = "doc_id long, text string, lang string, source string, n_chars long, block int, kept string, score double, rest string"
UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "the", "Or", "é", "st", "x."]) for _ in range(rng.randint(1, 4)))
    texts = []
    for _ in range(40):
        texts.append("\n".join(" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))))
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [texts[0], texts[0], "", None, " \t\n", "short", "SHORT  line\nshort Line ", "a  b \n\n c d", "<|endoftext|> x <|endoftext|>", "naïve 数据 ½   end's"]
    for k in (3, 5, 9):  # near copies: a word changed here and there
        w = texts[k].split(" ")
        for m in range(3):
            w2 = list(w)
            w2[rng.randrange(len(w))] = f"new{m}"
            texts.append(" ".join(w2))
    texts += [f"{word()} {passage} {word()}" for _ in range(4)]
    texts += [f"Common Header \n{word()} {i}" for i in range(12)]
    texts += ["w " * 3000, passage + " " + passage]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, 7, "clash", 0.5, "clash") for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def words(text, lower=False):
    return ((text or "").translate(UPPER) if lower else (text or "")).encode().split()


def rows_of(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_op1_bpe(docs, texts, empty):
    path = bpe.vocabulary_path("word_bpe_49k.json")
    t = bpe.tokenizer(path)
    got, plain = rows_of(bpe.encode(docs, path, digest=True)), rows_of(bpe.encode(docs, path))
    for i, x in texts.items():
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
        assert plain[i][1] == ids
    assert bpe.encode(empty, path).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs, bpe.vocabulary_path("byte_bpe_50k.json"))


def test_op2_packing(docs, texts, empty):
    t = bpe.tokenizer(bpe.vocabulary_path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, keep_ids=True).toPandas()
    for i, x in texts.items():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == i].sort_values("piece")
        assert [j for p in own.ids for j in p] == ids
        assert list(own.start) == [0, *np.cumsum(own.length)[:-1]]
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(own.ids, own.ids_crc32))
        assert all(n == 2048 for n in own.length[1:])
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert packing.pack_documents(empty).count() == 0


def one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms[rooms.index(fit)] -= n
    return len(rooms)


def test_best_fit_decreasing_equals_one_by_one():
    rng = random.Random(1)
    for _ in range(60):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 200))]
        runs = packing.best_fit_decreasing(Counter(lengths), 64)
        used, done = {}, Counter()
        for length, rank, each, first, offset in runs:
            many = sum(1 for x in lengths if x == length)
            after = [r for n, r, *_ in runs if n == length and r > rank]
            for r in range(rank, min(after, default=many)):
                used.setdefault(first + (r - rank) // each, []).append((offset + (r - rank) % each * length, length))
                done[length] += 1
        assert done == Counter(lengths)
        for parts in used.values():
            parts.sort()
            assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 64
        assert len(used) == one_by_one(lengths, 64)


def test_units_join_to_the_text_and_keep_its_ids():
    t = bpe.tokenizer(bpe.vocabulary_path("byte_bpe_50k.json"))
    for x in ["", " ", "  a", "a  b", "a \n b", "\n a", "don't  stop", "a  b", "x <|endoftext|>  y", "é½ 数  据", "t\t t", "a \x1c b"]:
        assert "".join(packing.units(x)) == x
        assert [i for u in packing.units(x) for i in t.encode(u, add_special_tokens=False).ids] == t.encode(x, add_special_tokens=False).ids


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def vectors(n=300, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(0, rng.choice([0, 0.01, 0.04]), dim)
        else:
            v = rng.normal(0, 1, dim)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    bad = [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [float("nan")] * dim, 1), (n + 3, [None] * dim, 1), (n + 4, rows[0][1], None), (n + 5, rows[0][1][:4], 0), (n + 6, [], 0)]
    return rows + bad


def exact_links(rows):
    good = [(k, np.array(v, np.float64), l) for k, (i, v, l) in enumerate(rows) if v and i is not None and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    return [(a, b) for k, (a, v, l) in enumerate(good) for b, w, m in good[:k] if l == m and len(v) == len(w) and v @ w / np.sqrt(v @ v * (w @ w)) >= 0.98]


@pytest.mark.parametrize("dim,tile", [(16, 512), (64, 512), (128, 7)])
def test_op3_embedding_dedup(spark, monkeypatch, dim, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rows = vectors(300, dim)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, links int")
    got, links = rows_of(embedding_dedup.near_duplicates(df)), exact_links(rows)
    wanted = Counter(x for p in links for x in p)
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(wanted.values()) > 100
    assert all(g[0] <= wanted[i] for i, g in got.items())
    exact = components(links, [r[0] for r in rows])
    assert sum(exact[i] == g[1] for i, g in got.items()) >= 0.98 * len(rows)
    assert all(g[2] == (g[1] == i) for i, g in got.items())
    assert all(got[r[0]] == (0, r[0], True) for r in rows[-7:] if r[0] != 305)


def test_op3_repeated_ids_keep_the_links_of_each_label(spark):
    rng = np.random.default_rng(8)
    a, b = ([float(np.float32(x)) for x in rng.normal(size=32)] for _ in range(2))
    rows = [(5, a, 0), (5, b, 1), (6, a, 0), (7, b, 1), (8, b, 1), (9, a, 1), (9, a, 1)]
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == Counter([(5, 1, 5, True), (5, 2, 5, True), (6, 1, 5, False), (7, 2, 5, False), (8, 2, 5, False), (9, 1, 9, True), (9, 1, 9, True)])
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("dim", [64, 128])
def test_bands_find_pairs_at_the_threshold(dim):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.98 * x + math.sqrt(1 - 0.98**2) * y
    a, b = (embedding_dedup.band_keys(m, embedding_dedup.BANDS, embedding_dedup.WIDTH) for m in (x, z))
    assert (a == b).any(axis=1).mean() > 0.98


def test_code_estimates_are_close_and_bounded():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    signs, factor, rounded, step = embedding_dedup.encode(x)
    guess, spread = embedding_dedup.estimate(np.where(signs, 1.0, -1.0), factor, rounded * step[:, None], step)
    gap = guess - x @ x.T
    assert abs(gap.mean()) < 0.01 and (np.abs(gap) <= spread).mean() > 0.999


def test_op4_lm_score(docs, texts, empty):
    got = rows_of(lm_score.score(docs))
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in [*words(t, True), 0])
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        own = [*words(t, True), 0]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert got[i][:4] == (held[i], len(own), sum(c[w] > 0 for w in own), n)
        assert got[i][4] == pytest.approx(base) and got[i][5] < 0
    assert lm_score.score(empty).count() == 0


def test_windows_score_each_token_once_and_only_from_the_past():
    rng = np.random.default_rng(0)
    model = lm_score.Model(rng.integers(1, 9, 50).astype(float), np.arange(50) % 2 == 0)
    text = rng.integers(0, 50, 100).astype(np.int32)
    seen = Counter()
    for t, first, context in zip(*lm_score.windows(np.array([99, 5, 32, 33, 56, 57]))):
        length = [99, 5, 32, 33, 56, 57][t]
        seen.update((t, p) for p in range(first + context, min(first + lm_score.WINDOW, length)))
    assert set(seen.values()) == {1} and len(seen) == 99 + 5 + 32 + 33 + 56 + 57
    other = text.copy()
    other[20:] = (other[20:] + 1) % 50
    (a, _), (b, _) = model.log_next(text[None, :31], text[None, 1:32]), model.log_next(other[None, :31], text[None, 1:32])
    assert np.allclose(a[0, :20], b[0, :20], atol=1e-5) and not np.allclose(a[0, 20:], b[0, 20:], atol=1e-5)


def test_training_lowers_the_loss():
    texts = [np.array([9, 1, 2, 3, 4] * 30 + [9], np.int32) for _ in range(10)]
    counts = np.bincount(np.concatenate(texts), minlength=12).astype(float)
    begins = np.isin(np.arange(12), [9, 2])
    model = lm_score.Model(counts, begins)
    sizes = [np.ones(149, np.int64)] * 10
    total = lambda: sum(x.sum() for x in lm_score.word_scores(model, texts, sizes))
    before = total()
    state = {}
    for k in range(20):
        lm_score.learn(model, texts, state, k, 20)
    assert total() > 0.5 * before


@pytest.mark.parametrize("shard,group", [(8192, 4096), (20, 7)])
def test_op5_topk(spark, monkeypatch, shard, group):
    monkeypatch.setattr(topk, "ROWS", shard)
    monkeypatch.setattr(topk, "QUERIES", group)
    rows = vectors(120) + [(500, [1e5] * 16, 0), (501, [-1e5] * 16, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 5 == 0, k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in ints if i % 5 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:7]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(topk.integer_vectors(df.limit(0)), F.col("vec_id") % 5 == 0).count() == 0
    with pytest.raises(ArithmeticError):
        topk._scores(np.full((1, 4), 1 << 31), np.full((1, 4), 1 << 31))


def test_op6_license(spark):
    rows = [(1, "a/LICENSE", "\nReleased under the MIT License.\nmore"), (2, "a/b/x.py", "code"), (3, "a/b/c/y.py", "text\n\nLicensed under CC BY-NC 4.0."), (4, "z.py", None), (5, None, "Released under the MIT License."), (6, "a/b/c/w.py", ""), (7, "d/h.py", "Licensed under the Apache License, Version 2.0.\nx"), (8, "d/i.py", "y"), (9, "d/i.py", "y")]
    got = rows_of(license.scan(spark.createDataFrame(rows, "row long, path string, text string")))
    assert {i: (g[3], g[4]) for i, g in got.items()} == {1: ("MIT", "file"), 2: ("MIT", "a"), 3: ("CC-BY-NC-4.0", "file"), 4: (None, None), 5: ("MIT", "file"), 6: ("MIT", "a"), 7: ("Apache-2.0", "file"), 8: ("Apache-2.0", "d"), 9: ("Apache-2.0", "d")}
    assert license.scan(spark.createDataFrame([], "row long, path string, text string")).count() == 0


def test_op6_headers_and_files(spark):
    wrapped = lambda text, mark: "\n".join(mark + " ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
    rows, want = [], []
    for k, (name, templates) in enumerate(license.TEMPLATES.items()):
        rows.append((f"h{k}", f"p{k}/x.c", wrapped(templates[0], " * ") + "\n\nint main() { return 0; }\n" + "some other code words\n" * 5))
        rows.append((f"f{k}", f"q{k}/LICENSE.txt", "Copyright 2020 Someone\n\n" + templates[0]))
        rows.append((f"g{k}", f"q{k}/deep/er/y.c", "nothing of the kind"))
        want += [(f"h{k}", name, "file"), (f"f{k}", name, "file"), (f"g{k}", name, f"q{k}")]
    same = {"GPL-2.0": "GPL-3.0"}  # headers that differ in one figure
    rows += [("a", "same/a.py", "plain"), ("a", "same/b.py", "Released under the MIT License."), (None, None, "text"), ("c", "other/c.py", "mit\n\nmit\n\nlicense")]
    got = {r.row: (r.license, r["from"]) for r in license.scan(spark.createDataFrame(rows, "row string, path string, text string").withColumn("score", F.lit(3))).collect() if r.row not in ("a", None)}
    for row, name, source in want:
        assert got[row][0] in (name, same.get(name, name), {v: k for k, v in same.items()}.get(name)) and got[row][1] == source, row
    assert got["c"] == (None, None)
    twice = [(r.path, r.license) for r in license.scan(spark.createDataFrame(rows[-4:], "row string, path string, text string")).where("row = 'a'").collect()]
    assert sorted(twice) == [("same/a.py", "MIT"), ("same/b.py", "MIT")]  # by the directory, not by the shared id


def test_every_template_has_decisive_words():
    assert all(license.decisive(v, 0.75, several)[0] for several in (False, True) for v in license.weights(license.TEMPLATES)[1].values())


def test_op7_quality(spark, docs, empty):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "river", "walks", "slowly", "home"]) for _ in range(40))
    junk = lambda: " | ".join(rng.choice(["zz", "qq##", "%%x"]) for _ in range(40))
    rows = [(i, good() if i % 2 else junk(), i % 2) for i in range(300)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score_quality(df, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(held) > 50 and sum((got[r[0]] >= 0.5) == (r[2] == 1) for r in held) / len(held) > 0.97
    none = quality.score_quality(docs, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0


def test_scores_equal_the_mean_of_the_features():
    import pyarrow as pa

    w = np.random.default_rng(0).normal(size=quality.BUCKETS).astype(np.float32)
    some = ["the the end", "a", "", "é½ x x x", "long " * 500]
    got = quality.score_texts(pa.array(some), w, 0.25)
    for x, s in zip(some, got):
        at, n = quality.features(x)
        assert s == pytest.approx(1 / (1 + math.exp(-((w[at] * n).sum() / max(n.sum(), 1) + 0.25))))


@pytest.mark.parametrize("window,first", [(35, 18), (8, 3), (5, 5)])
def test_op8_substring_dedup(docs, texts, window, first):
    got = rows_of(substring_dedup.drop_repeated_windows(docs, window, first))
    w = {i: words(t) for i, t in texts.items()}
    seen = Counter(tuple(x[k : k + window]) for x in w.values() for k in range(len(x) - window + 1))
    removed = 0
    for i, x in w.items():
        gone = [False] * len(x)
        for k in range(len(x) - window + 1):
            if seen[tuple(x[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        assert got[i] == (len(x), sum(gone), b" ".join(a for a, g in zip(x, gone) if not g).decode())
        removed += sum(gone)
    assert removed > 100


def test_op8_keeps_columns_and_takes_empty_tables(docs, empty):
    assert substring_dedup.drop_repeated_windows(docs, keep=("lang", "source")).columns == ["doc_id", "n_words", "n_removed", "kept", "lang", "source"]
    assert substring_dedup.drop_repeated_windows(empty).count() == 0


def test_op9_line_dedup(docs, texts, empty):
    got = rows_of(line_dedup.drop_common_lines(docs, min_docs=3, min_chars=2))
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(UPPER)
    found = Counter(k for t in texts.values() for k in {key(x) for x in (t or "").split("\n")})
    drop = {k for k, n in found.items() if n >= 3 and len(k) >= 2}
    assert "common header" in drop
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in drop]
        assert got[i] == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.drop_common_lines(empty).count() == 0
    assert line_dedup.line_index(docs).agg(F.sum("n_keys")).first()[0] == len({k for k in found if k})


def test_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    keys, others = np.zeros(5000, KEY), np.zeros(5000, KEY)
    for c in ("hi", "lo"):
        keys[c], others[c] = rng.integers(0, 2**63, 5000), rng.integers(0, 2**63, 5000)
    keys["lo"][:2500] = 7  # one half alone tells keys apart
    index = line_dedup.Index(line_dedup.build_index(keys, np.arange(len(keys), dtype=np.uint32)))
    assert (index.lookup(keys) == np.arange(len(keys))).all()
    assert sorted(index.places(keys)) == list(range(len(keys)))
    assert (index.lookup(others) > 0).mean() < 0.01


@pytest.mark.parametrize("size,percent", [(5, 75), (2, 40)])
def test_op10_ngram_join(docs, texts, empty, size, percent):
    got = rows_of(ngram_join.near_duplicates(docs, size, percent).select("doc_id", "n_shingles", "component_id"))
    sets = {}
    for i, t in texts.items():
        w = words(t, True)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = components(links, sets)
    assert len(links) > 5 and got == {i: (len(s), root[i]) for i, s in sets.items()}
    assert ngram_join.near_duplicates(empty).count() == 0


def test_op10_chains_and_null_ids(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(12):  # each links with the next only
        rows.append((100 - k, " ".join(base[k * 4 :] + [f"t{j}" for j in range(k * 4)])))
    rows += [(None, rows[0][1]), (None, rows[0][1])]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [(i, {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}) for i, t in rows if i is not None]
    root = components([(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 75 * len(x | y)], [i for i, _ in sets])
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == root
    assert [r.component_id for r in got if r.doc_id is None] == [89, 89]  # rows without doc_id are documents too


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (None, 3)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("f", [lambda d: bpe.encode(d, bpe.vocabulary_path("word_bpe_49k.json"), digest=True), packing.pack_documents, substring_dedup.drop_repeated_windows, line_dedup.drop_common_lines])
def test_repeated_and_null_ids(spark, f):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "x"), (None, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in f(df).collect()) == ["1", "1", "None", "None"]
