"""A training corpus from raw documents: five stages, each written as Parquet and read again.

A null text is kept by the toxicity stage (it matches nothing), and goes at language ID, which can't name
its language. Columns besides doc_id and text pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, jaccard, language, packing, toxicity
from pairloom.llm.common import Scratch, crc_mod, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learnt from the labels of documents that are not held out, scores as toxic go."""
    model = toxicity.fit(toxicity.training(docs, table(spark, sf_dir, "labels")))
    return toxicity.clean(docs, model)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose best language has less than half of the decoder's weight, go."""
    small_batches(spark)
    model = language.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    return language.known(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that links by 0.8 of their five-word shingles."""
    return jaccard.one_of_each(docs, 5, 8, 10)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontaminate.remove(spark, docs, table(spark, sf_dir, "benchmark"), "document")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

#: Learnt scores and best-fit packing are not expressible in SQL; tests/llm hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
