"""The training-data pipeline over ``documents``: language ID, quality rules, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.  All but
the last return the columns of documents.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockspark.llm import langid, minhash, packing, pii, quality
from blockspark.llm.common import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is surely in one of the corpus's languages, and in that of their lang column.

    Those without a letter, with null text, without a known n-gram, or of another or no clear language go.  The filters learn from the
    documents' own lang column.
    """
    return langid.keep(docs, langid.train(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what neither the base nor a rule of the cascade rejects."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (similarity of 0.8 or more), the one with the smallest doc_id.

    Rows without a doc_id are no one's copies and stay; of rows of one doc_id each is judged by its own text.
    """
    return minhash.keep(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with personal data and revealing terms replaced by their kind; n_chars follows the new text."""
    return pii.masked(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("best_fit_packing", best_fit_packing)]

#: SQL cannot express the stages (Bloom filters, sketches, tokenizers); tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written in the shared checkpoint folder and read again."""
    shared = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = os.path.join(shared, f"pipeline-{uuid.uuid4().hex}", name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
