"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. Stages
but the last return the columns of documents; where a stage changes texts, ``n_chars`` follows.
run() writes each stage's rows as Parquet to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genonet.llm import decontaminate, jaccard, linededup, pieces, quality
from genonet.llm.common import drop_folder, passing, scratch_dir, written
from genonet.llm.queries import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the likelihood ratio."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that an earlier document holds out of the texts; every document stays."""
    out = linededup.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left; ids' digests and whether they decode to the text."""
    return pieces.report(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The likelihood ratio and the pieces have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        at = scratch_dir(spark)
        with passing(spark):
            docs = written(stage(spark, docs, sf_dir), at)
        if before:
            drop_folder(spark, before)
        before = at
    return docs
