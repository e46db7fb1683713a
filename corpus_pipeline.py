"""Five stages from raw documents to packed sequences. Each reads what its predecessor kept; run() writes every stage as a table.

Any of documents' columns may hold nulls, and other columns of any names may be there; the first four stages return the columns of their input. Texts of any length are read whole.
An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import common, decontaminate, language_id, ngram_join, packing, secrets


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or between two languages, go.

    Rows without lang or doc_id teach nothing but are judged like any other; repeated rows are judged alike. Where nothing can be learnt, all go.
    """
    common.small_batches(spark)
    return language_id.keep_known(docs, language_id.learn(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by five words and a similarity of 0.8 the one with the least doc_id stays.

    Null and empty texts, which have no words, stay. A row without a doc_id stays if no linked one has a doc_id and its text comes first by hash. Of rows equal in doc_id and text one stays.
    """
    common.small_batches(spark)
    return ngram_join.keep_one(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    Null and empty texts leak nothing and stay, as do rows without a doc_id whose text is clean; repeated rows are judged alike. Without a benchmark all stay.
    """
    common.small_batches(spark)
    return decontaminate.drop_leaked(docs, common.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and n_chars is set anew where a text changed; no document goes.

    Null and empty texts stay as they are; repeated rows and rows without a doc_id are masked like any other.
    """
    common.small_batches(spark)
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths.

    A null or empty text is the closing id alone; repeated rows and rows without a doc_id are packed as documents of their own.
    """
    common.small_batches(spark)
    return packing.pack(docs, sparing=True)  # the workers serve the other stages too


STAGES = [("language", known_language), ("near_copies", one_of_near_copies), ("benchmark", without_benchmark), ("secrets", without_secrets), ("packing", packed)]
#: Tokenizers, trained classifiers and edit distances have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.written(docs, f"stage_{name}")
    return docs
