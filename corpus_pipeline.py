"""A training corpus in five stages: quality filter, line dedup, near dedup, substring dedup, packing.

Each stage takes the documents that the one before kept and returns documents (doc_id, text, lang, source, n_chars);
the last returns the pieces of the packed sequences. ``run`` applies them to ``documents``, each stage written and
read again.

Defined results of every stage: null text is empty text; rows with equal or null doc_id are rows each on its own, but for
near_dedup; other columns than those of documents are left out; an empty table gives none. A document that has no word left
goes at line_dedup and substring_dedup; the quality filter judges an empty text by the bias alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm.line_dedup import drop_common_lines
from flowlake.llm.ngram_join import first_of_each
from flowlake.llm.packing import pack_documents
from flowlake.llm.quality import score_quality
from flowlake.llm.substring_dedup import drop_repeated_windows
from flowlake.tables import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_DOCS = 10


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels, keep=COLUMNS).where("score >= 0.5").select(*COLUMNS)


def _with_text(kept: DataFrame) -> DataFrame:
    """Documents with the kept texts; those that have no word left go."""
    out = kept.withColumnRenamed("kept", "text").where(F.length(F.btrim("text", F.lit(" \t\n\r\x0b\x0c"))) > 0)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in MIN_DOCS documents or more go from all of them."""
    return _with_text(drop_common_lines(docs, min_docs=MIN_DOCS, keep=("lang", "source")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest doc_id (rows without one last). Rows under one doc_id
    are a group, and so are equal rows; rows without words stay."""
    return first_of_each(docs).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 35 words that also start elsewhere go."""
    return _with_text(drop_repeated_windows(docs, keep=("lang", "source")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]
ORACLE_SQL = None  # the classifier and the tokenizer have no SQL form; tests/llm covers columns, subsets and labelled recall of the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
