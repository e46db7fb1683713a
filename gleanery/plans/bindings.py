"""The shared tables seen as a library's items, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import tags as T
from gleanery.sources.tables import table


def items(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the vector of the same number: language as kind, source and language as tags."""
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    one = lambda name, label, source, score: F.struct(F.col(label).alias("label"), F.lit(name).alias("category"), score.alias("score"), F.lit(source).alias("source"))
    share = F.round((F.col("n_chars") % 100) / 100.0, 2)
    tags = F.array(one("topic", "lang", "prompt", share), one("topic", "source", "manual", F.lit(1.0))).cast(T.TAGS)
    joined = docs.join(vectors, docs.doc_id == vectors.vec_id)
    return joined.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), "embedding", F.lit(None).cast("array<float>").alias("caption_embedding"), F.lower("text").alias("search_text"), tags.alias("tags"), F.col("n_chars").alias("modified_at"), "source")


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector with the least number: one row."""
    return list(table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0])


def words(spark: SparkSession, d: str) -> list[str]:
    """The first benchmark item's first words: one row."""
    text = table(spark, d, "benchmark").orderBy("item_id").select("text").first()[0]
    return [w for w in text.lower().split() if len(w) > 2][:3]


Q = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"
TERMS = "(SELECT list_filter(string_split_regex(lower(text), '\\s+'), lambda w: len(w) > 2)[1:3] FROM benchmark ORDER BY item_id LIMIT 1)"
ITEMS = """items AS (SELECT doc_id AS id, lang AS kind, embedding::DOUBLE[] AS embedding, lower(text) AS search_text, n_chars AS modified_at, source, round((n_chars % 100) / 100.0, 2) AS share, lower(lang) || ' ' || lower(source) AS tag_hay
  FROM documents JOIN embeddings ON doc_id = vec_id)"""
HIT = "len(list_filter(t.terms, lambda w: contains({hay}, w)))"
LEXICAL = "0.35 * {h} / len(t.terms) + CASE WHEN {h} = len(t.terms) THEN 0.6 ELSE 0 END"
TAG = "CASE WHEN {h} > 0 THEN 2.5 * {h} / len(t.terms) + CASE WHEN {h} = len(t.terms) THEN 3.0 ELSE 0 END ELSE 0 END"
