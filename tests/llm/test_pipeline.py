"""The stages take and return documents, and leave clean documents in."""

import corpus_pipeline as P

from flowlake.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_are_the_operators_in_order():
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    assert len(queries.QUERIES) == 13


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    start, seen = {r.doc_id for r in docs.collect()}, {}
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == list(P.COLUMNS)
        seen[name] = {r.doc_id for r in docs.collect()}
        assert all(r.n_chars == len(r.text) and r.text.strip() for r in docs.collect()) or name in ("quality", "near_dedup")
    assert seen["quality"] <= start and seen["substring_dedup"] <= seen["near_dedup"] <= seen["line_dedup"] <= seen["quality"]
    good = {i for i, q in labels.items() if q}
    assert len(seen["quality"] & good) >= 0.97 * len(good)
    packed = P.packing(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == seen["substring_dedup"]
