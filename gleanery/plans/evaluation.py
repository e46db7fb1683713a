"""Retrieval evaluation on label centroids, AUC, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import vectors
from gleanery.operators import evaluate, search
from gleanery.plans.register import query
from gleanery.plans.tagging import CENTRES
from gleanery.sources.tables import table

RANKS = f"{CENTRES}, s AS (SELECT m.label AS query, vec_id AS id, e.label = m.label AS relevant, row_number() OVER (PARTITION BY m.label ORDER BY list_dot_product(embedding::DOUBLE[], v) DESC, vec_id) AS rank FROM embeddings e, m)"


def _library(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Items, and each label's centroid as a query (as many queries as labels)."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("image"), F.lit(None).cast("array<float>").alias("caption"), F.lit("").alias("search_text"), "label")
    queries = vectors.mean_vector(v, "image", ("label",)).select(F.col("label").alias("query"), F.col("mean").alias("query_vec"), F.array().cast("array<string>").alias("terms"))
    return v, queries


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    v, queries = _library(spark, d)
    return search.rank_for_eval(v.drop("label"), queries, dense_only=True).join(v.select("id", "label"), "id").withColumn("relevant", F.col("label") == F.col("query"))


@query(f"""WITH {RANKS}, x AS (SELECT query, min(id) AS id FROM s WHERE relevant GROUP BY query), r AS (SELECT s.rank FROM s JOIN x USING (query, id))
SELECT count(*) AS queries, round(avg((rank <= 1)::INT), 6) AS recall_at_1, round(avg((rank <= 5)::INT), 6) AS recall_at_5, round(avg((rank <= 10)::INT), 6) AS recall_at_10, round(avg(1.0 / rank), 6) AS mrr FROM r""")
def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Each label's least item is the expected one."""
    v, queries = _library(spark, d)
    expected = v.groupBy(F.col("label").alias("query")).agg(F.min("id").alias("id"))
    out = evaluate.retrieval(search.ranks_of(v.drop("label"), queries, expected, dense_only=True))
    return out.select("queries", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(f"""WITH {RANKS}, h AS (SELECT query, rank, row_number() OVER (PARTITION BY query ORDER BY rank) AS hit FROM s WHERE relevant),
q AS (SELECT query, avg(hit / rank) AS ap, count(*) FILTER (WHERE rank <= 5) / 5 AS p5, count(*) FILTER (WHERE rank <= 10) / count(*) AS r10, 1.0 / min(rank) AS rr FROM h GROUP BY query)
SELECT count(*) AS queries, round(avg(ap), 6) AS map, round(avg(p5), 6) AS p5, round(avg(r10), 6) AS r10, round(avg(rr), 6) AS mrr FROM q""")
def aspect_map(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.aspects(_ranks(spark, d))
    return out.select("queries", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("""WITH r AS (SELECT n_chars AS s, quality = 1 AS ok FROM labels JOIN documents USING (doc_id)), k AS (SELECT ok, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM r)
SELECT round((sum(rk) FILTER (WHERE ok) - count(*) FILTER (WHERE ok) * (count(*) FILTER (WHERE ok) + 1) / 2) / (count(*) FILTER (WHERE ok) * count(*) FILTER (WHERE NOT ok)), 9) AS auc FROM k""")
def auc_quality(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("correct"))
    return evaluate.auc(scored).select(F.round("auc", 9).alias("auc"))


SCORED = "SELECT doc_id AS id, (n_chars % 1000) / 1000 AS score, quality = 1 AS correct FROM labels JOIN documents USING (doc_id)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return joined.select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 1000) / 1000).alias("score"), (F.col("quality") == 1).alias("correct"))


@query(f"""WITH p AS ({SCORED}), e(bin, low, high) AS (VALUES (1, 0.1, 0.25), (2, 0.25, 0.4), (3, 0.4, 0.6), (4, 0.6, 0.8), (5, 0.8, 1.01))
SELECT bin, low::DOUBLE AS low, high::DOUBLE AS high, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(correct::INT), 6) AS accuracy FROM p JOIN e ON score >= low::DOUBLE AND score < high::DOUBLE GROUP BY ALL""")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.calibration(_scored(spark, d)).select("bin", "low", "high", "n", F.round("mean_score", 6).alias("mean_score"), F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH p AS ({SCORED}), t(tier) AS (VALUES ('recognized'), ('weak'), ('unknown')), c AS (SELECT CASE WHEN score >= 0.56 THEN 'recognized' WHEN score > 0 THEN 'weak' ELSE 'unknown' END AS tier, count(*) AS n, avg(correct::INT) AS precision FROM p GROUP BY 1)
SELECT tier, coalesce(n, 0) AS n, round(precision, 6) AS precision, round(coalesce(n / (SELECT count(*) FROM p), 0), 6) AS share FROM t LEFT JOIN c USING (tier)""")
def tier_table(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.tier_table(_scored(spark, d).withColumnRenamed("score", "confidence"))
    return found.select("tier", "n", F.round("precision", 6).alias("precision"), F.round("share", 6).alias("share"))


@query(f"""WITH p AS ({SCORED}), g AS (SELECT quality AS grp, (n_chars % 100) >= 50 AS ok, n_chars AS s FROM labels JOIN documents USING (doc_id)),
k AS (SELECT grp, ok, rank() OVER (PARTITION BY grp ORDER BY s) + (count(*) OVER (PARTITION BY grp, s) - 1) / 2 AS rk FROM g)
SELECT grp, round((sum(rk) FILTER (WHERE ok) - count(*) FILTER (WHERE ok) * (count(*) FILTER (WHERE ok) + 1) / 2) / (count(*) FILTER (WHERE ok) * count(*) FILTER (WHERE NOT ok)), 9) AS auc FROM k GROUP BY grp""")
def signal_aucs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("quality").alias("grp"), F.col("n_chars").alias("score"), (F.col("n_chars") % 100 >= 50).alias("correct"))
    return evaluate.auc(rows, ["grp"]).select("grp", F.round("auc", 9).alias("auc"))


@query("""WITH c AS (SELECT doc_id AS id, [lang, source] AS must_find FROM documents), p AS (SELECT doc_id AS id, [CASE WHEN quality = 1 THEN (SELECT lang FROM documents d WHERE d.doc_id = l.doc_id) ELSE 'none' END] AS tags FROM labels l),
j AS (SELECT must_find, tags, len(list_filter(must_find, lambda m: tags IS NOT NULL AND contains(tags[1], m))) AS found FROM c LEFT JOIN p USING (id))
SELECT count(*) AS cases, round(sum(found) / sum(len(must_find)), 6) AS must_find_rate, count(*) FILTER (WHERE tags IS NULL) AS missing FROM j""")
def tagging_score(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    cases = docs.select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("must_find"))
    said = table(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.array(F.when(F.col("quality") == 1, F.col("lang")).otherwise("none")).alias("tags"))
    return evaluate.tagging(cases, said).select("cases", F.round("must_find_rate", 6).alias("must_find_rate"), "missing")
