"""From raw documents to packed training windows: each stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.contamination import decontaminate
from parchment.llm.jaccard import keep_one
from parchment.llm.language import reject_language
from parchment.llm.mixing import pack_mixture
from parchment.llm.store import saved
from parchment.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; learned from the labels that aren't held out.

    Null and empty texts stay, as does every row when there are no labels; repeated rows are judged alike, null ids kept; an empty table gives no rows.
    """
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language (null texts, texts without a letter) go.

    Of languages that fit alike the first by name is taken; repeated rows are judged alike, null ids kept; all rows go when nothing can be learned; an empty table gives no rows.
    """
    return reject_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Null ids come last; of repeated rows one stays; texts without words are groups of their own and stay; an empty table gives no rows.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words in windows of benchmark items go.

    Null and empty texts and, under an empty benchmark, all rows stay; repeated rows are judged alike; an empty table gives no rows.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 tokens with every source's share.

    A null or empty text is its end id alone, a null source a queue of its own; repeated rows and null ids are rows of their own; an empty table gives no rows.
    """
    pieces = pack_mixture(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The toxicity and language models, connected components and the tokenizer are beyond SQL; ``tests/llm/test_pipeline.py`` holds near duplicates and decontamination against brute force, toxicity, language and packing against a plain loop over the library's own reader, parser and tokenizer, which have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
