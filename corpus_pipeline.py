"""Corpus pipeline: from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import decontam, line_dedup, ngram_join, packing, toxicity
from tally.llm.common import cut, drop_cuts_since, mark
from tally.llm.queries import table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines one stays; documents left without text go."""
    return line_dedup.dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar documents one stays."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of windows of 1024 token ids."""
    pieces = packing.pack(docs, vocabulary())
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_join", dedup_documents), ("decontamination", decontaminate), ("packing", pack)]

#: Learned scores, tokenizers and iteration have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents on; what a stage leaves behind goes when the next has run."""
    docs, begun = table(spark, sf_dir, "documents"), mark()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        drop_cuts_since(spark, begun, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
