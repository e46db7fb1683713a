"""Grades of a tagger on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import tags as T
from gleanery.functions import vectors
from gleanery.operators import grading
from gleanery.plans.register import query
from gleanery.plans.tagging import CENTRES
from gleanery.sources.tables import table


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Documents: the source as a manual, the language as an exemplar's tag; every third document's model says its language, every fifth's caption its source."""
    i = F.col("doc_id")
    tag = lambda label, source: F.struct(F.upper(label).alias("label"), F.lit("topic").alias("category"), F.lit(1.0).alias("score"), F.lit(source).alias("source"))
    tags = F.array_compact(F.array(F.when(i % 7 > 0, tag("source", "manual")), tag("lang", "exemplar"), F.when(i % 3 == 0, tag("lang", "vision")))).cast(T.TAGS)
    return table(spark, d, "documents").select(i.alias("id"), F.when(i % 5 == 0, F.concat(F.lit("seen  on "), "source")).alias("caption"), tags.alias("tags"))


SAID = """a AS (SELECT doc_id AS id, unnest(list_distinct([CASE WHEN doc_id % 7 > 0 THEN source ELSE lang END, lang])) AS label, CASE WHEN doc_id % 3 = 0 THEN lang || ' ' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN 'seen on ' || source ELSE '' END AS hay FROM documents)"""


@query(f"WITH {SAID} SELECT label, count(*) AS asserted, count(*) FILTER (WHERE contains(hay, label)) AS agreed FROM a WHERE hay <> '' GROUP BY label")
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    return grading.label_agreement(grading.assertions(_items(spark, d)))


@query(f"WITH {SAID} SELECT label, id FROM a WHERE hay <> '' AND NOT contains(hay, label)")
def missed_labels(spark: SparkSession, d: str) -> DataFrame:
    return grading.missed(grading.assertions(_items(spark, d)))


@query(f"""WITH {SAID}, i AS (SELECT id, count(*) FILTER (WHERE hay <> '') AS n, count(*) FILTER (WHERE hay <> '' AND contains(hay, label)) AS g FROM a GROUP BY id)
SELECT count(*) AS with_truth, count(*) FILTER (WHERE n = 0) AS undescribed, sum(n)::BIGINT AS assertions, sum(g)::BIGINT AS agreed, round(sum(g) / sum(n), 6) AS rate FROM i""")
def agreement_summary(spark: SparkSession, d: str) -> DataFrame:
    return grading.agreement_summary(grading.assertions(_items(spark, d))).withColumn("rate", F.round("rate", 6))


CASES = """c AS (SELECT doc_id AS id, [lang || ' ' || source, 'src1'] AS must, ['topic', 'emotion'] AS expect FROM documents), p AS (SELECT l.doc_id AS id, [CASE WHEN quality = 1 THEN lang ELSE 'none' END, source, CASE WHEN toxic = 1 THEN 'angry' ELSE 'calm' END] AS tags FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
g AS (SELECT c.id, tags IS NOT NULL AS has_prediction, list_filter(must, lambda m: tags IS NOT NULL AND contains(array_to_string(tags, ' '), m)) AS matched, list_filter(expect, lambda f: tags IS NULL OR NOT CASE f WHEN 'topic' THEN tags[1] IN ('en', 'fr') ELSE tags[3] = 'angry' END) AS lacking FROM c LEFT JOIN p USING (id))"""


def _graded(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    cases = docs.select(F.col("doc_id").alias("id"), F.array(F.concat_ws(" ", "lang", "source"), F.lit("SRC1")).alias("must_find"), F.array(F.lit("topic"), F.lit("emotion")).alias("expect_facets"))
    tags = F.array(F.when(F.col("quality") == 1, F.col("lang")).otherwise("none"), "source", F.when(F.col("toxic") == 1, "angry").otherwise("calm"))
    said = table(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), tags.alias("tags"))
    return grading.graded_cases(cases, said, spark.createDataFrame([("en", "topic"), ("fr", "topic"), ("angry", "emotion")], "label string, facet string"))


@query(f"WITH {CASES} SELECT id, has_prediction, array_to_string(matched, '|') AS matched_terms, array_to_string(lacking, '|') AS missing_facets, len(matched) > 0 AS found FROM g")
def tagging_cases(spark: SparkSession, d: str) -> DataFrame:
    found = _graded(spark, d)
    return found.select("id", "has_prediction", F.lower(F.array_join("matched_terms", "|")).alias("matched_terms"), F.array_join("missing_facets", "|").alias("missing_facets"), "found")


@query(f"WITH {CASES} SELECT count(*) AS n, round(avg((len(matched) > 0)::INT), 6) AS must_find_rate, round(1 - sum(len(lacking)) / (2 * count(*)), 6) AS facet_recall FROM g")
def tagging_summary(spark: SparkSession, d: str) -> DataFrame:
    return grading.case_summary(_graded(spark, d)).select("n", F.round("must_find_rate", 6).alias("must_find_rate"), F.round("facet_recall", 6).alias("facet_recall"))


@query(f"""WITH {CENTRES}, s AS (SELECT e.vec_id AS id, e.label = m.label AS own, list_dot_product(embedding::DOUBLE[], v) AS x FROM embeddings e, m), r AS (SELECT id, 1 + count(*) FILTER (WHERE x > y) AS rank FROM s JOIN (SELECT id, x AS y FROM s WHERE own) USING (id) GROUP BY id)
SELECT count(*) AS n, (SELECT count(*) FROM m) AS labels, round(avg((rank <= 1)::INT), 6) AS recall_at_1, round(avg((rank <= 3)::INT), 6) AS recall_at_3, round(avg((rank <= 5)::INT), 6) AS recall_at_5, round(avg(1.0 / rank), 6) AS mrr FROM r""")
def zero_shot_recall(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as an item that a query by its label's centroid expects."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("query"))
    centres = vectors.mean_vector(v, "embedding", ("query",)).withColumnRenamed("mean", "vector")
    asked = v.select(F.col("id").alias("number"), F.col("id").alias("expected_id"), "query").join(centres, "query")
    found = grading.zero_shot(v.select("id", F.col("embedding").alias("vector")), asked)
    return found.select("n", "labels", *[F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_3", "recall_at_5", "mrr")])


@query("""WITH t AS (SELECT DISTINCT doc_id AS id, replace(unnest([source || '_' || lang, lang, 'from-' || source]), '-', ' ') AS tag FROM documents), n AS (SELECT DISTINCT id, replace(tag, '_', ' ') AS tag FROM t WHERE length(tag) >= 3),
c AS (SELECT tag, count(*) AS n FROM n GROUP BY tag HAVING count(*) >= 3 ORDER BY n DESC, tag LIMIT 80) SELECT tag, id FROM n JOIN c USING (tag)""")
def golden_aspects(spark: SparkSession, d: str) -> DataFrame:
    """Source and language of documents as tags; a language's name alone is too short."""
    tags = F.array(F.concat_ws("_", F.upper("source"), "lang"), F.col("lang"), F.concat(F.lit("from-"), "source"))
    _, relevant = grading.golden_aspects(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(tags).alias("tag")))
    return relevant
