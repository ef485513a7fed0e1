"""A corpus pipeline over ``documents``: classify, dedup, near-dedup, mix, encode.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.

Defined results: all stages but the last return the columns of ``docs``, whatever their
names; null texts are read as empty.  ``classify`` gives repeated rows one verdict and
judges null ids like others; ``exact`` and ``near`` keep one row of each group, also of rows
that repeat id and text, prefer an id to a null one, and ``near`` keeps every row without
words; ``mix`` treats a null source as one of its own; ``encode`` gives empty texts no
ids.  Texts are worked on whole, and an empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm import exact_dedup, minhash, mixing, quality_gam, sentencepiece_codec
from gramloom.llm.common import Scratch
from gramloom.llm.queries import PIECE_MODEL


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality_gam.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of exact copies."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, 0.8)."""
    return minhash.drop_near_copies(docs, n=5, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in the mix: doc_id, source, n_tokens, ids, ids_crc32."""
    plain = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    coded = sentencepiece_codec.encode(plain, PIECE_MODEL, "n_tokens", "ids", "ids_crc32")
    return coded.select("doc_id", "source", "n_tokens", "ids", "ids_crc32")


STAGES = [("classify", classify), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: The classifier and the encoder have no SQL form; a test runs brute force beside the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
