"""What an earlier version lost: licence units without a word of a list, ids of very long words, columns that bear helpers' names."""

import math
import re
from collections import Counter

import numpy as np

from flowlake.llm import license, lm_score, ngram_join


def plain_cosines(text):
    """The best score of each licence, by the definition."""
    idf, vectors, unknown = license.weights(license.TEMPLATES)
    own = {w: (1 + math.log(c)) * idf.get(w, unknown) for w, c in Counter(re.findall("[a-z0-9]+", text.lower())).items()}
    norm, best = math.sqrt(sum(x * x for x in own.values())), {}
    for (name, _), v in vectors.items():
        shared = own.keys() & v.keys()
        score = round(sum(own[w] * v[w] for w in shared) / norm, 6) if len(shared) > 1 else 0
        if score >= license.THRESHOLD:
            best[name] = max(best.get(name, 0), score)
    return best


def test_no_unit_that_matches_is_lost(spark):
    lines = ["BSD 2-Clause", "Creative Commons Attribution 4.0 International", "The MIT", "Mozilla Public Version 2.0", "plain words of no licence at all", "MIT", "version 3", "GNU GENERAL PUBLIC"]
    for some in license.TEMPLATES.values():
        for t in some:
            w = t.split()
            lines += [t, " ".join(w[: max(2, len(w) * 2 // 3)]), " ".join(w[len(w) // 4 :]), " ".join(x for i, x in enumerate(w) if i % 5), " ".join(x for i, x in enumerate(w) if i % 3), " ".join(w[::2])]
    lines = sorted({x.replace("\n", " ") for x in lines if re.search("[a-z0-9]", x.lower())})
    want = {(i, name): score for i, x in enumerate(lines) for name, score in plain_cosines(x).items()}
    texts = spark.createDataFrame([(i, False, x) for i, x in enumerate(lines)], "key int, named boolean, text string")
    got = {(r.key, r.license): r.score for r in license.scan_units(texts).where("unit = 0").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    assert {"BSD 2-Clause", "The MIT", "Creative Commons Attribution 4.0 International"} <= {lines[i] for i, _ in want}


def test_op4_keeps_all_ids_of_a_very_long_word(spark, monkeypatch):
    word = "".join("qxzvkj"[i * i % 6] for i in range(160_000))
    df = spark.createDataFrame([(1, f"one {word} two"), (2, "one two"), (3, "two one")], "doc_id long, text string")
    passed, rounds = [], lm_score.train_blocks
    monkeypatch.setattr(lm_score, "train_blocks", lambda model, texts, *a: passed.append(texts) or rounds(model, texts, *a))
    out = lm_score.score(df).toPandas().set_index("doc_id")
    assert out.n_tokens.to_dict() == {1: 4, 2: 3, 3: 3} and out.score.notna().all()
    kept = [lm_score.Block(r.asDict(), np.uint16) for r in passed[0].collect()]
    assert sum(int(b.size.max()) > 65536 for b in kept) == 1 and all(len(b.ids) == b.size.sum() for b in kept)


def test_first_of_each_keeps_columns_of_any_name(spark):
    text = "a few words that make a text of some length"
    rows = [(3, text, "c", "k", 1, "r"), (1, text, "d", "l", 2, "s"), (1, text, "e", "m", 3, "t"), (None, text, "f", "n", 4, "u"), (None, "", "g", "o", 5, "v"), (5, None, "h", "p", 6, "w"), (7, "other words stand here alone today", "i", "q", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, copy string, own_key string, best_id int, own_row string")
    got = ngram_join.first_of_each(df)
    assert got.columns == df.columns
    kept = sorted(map(tuple, got.collect()), key=str)
    assert set(kept) <= set(rows) and len(kept) == 4 and {r[0] for r in kept} == {1, None, 5, 7}
    assert ngram_join.first_of_each(df.limit(0)).count() == 0
