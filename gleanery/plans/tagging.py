"""Tags, classification, clusters of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import tags as T
from gleanery.functions import vectors
from gleanery.operators import evaluate, learn, merge, mining
from gleanery.plans import bindings as B
from gleanery.plans.register import query
from gleanery.sources.tables import table

CENTRES = "c AS (SELECT label, i AS pos, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i), m AS (SELECT label, list(x ORDER BY pos) AS v FROM c GROUP BY label)"
CONFIDENCE = "CASE WHEN {m} <= 0.115 THEN 0.03 " + " ".join(f"WHEN {{m}} <= {x1} THEN {y0} + ({{m}} - {x0}) / ({x1} - {x0}) * ({y1} - {y0})" for (x0, y0), (x1, y1) in zip(T.CALIBRATION, T.CALIBRATION[1:])) + " ELSE 0.9 END"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return vectors.mean_vector(_vectors(spark, d), "embedding", ("label",)).withColumnRenamed("mean", "vector")


@query(f"""WITH {CENTRES}, a AS (SELECT {B.Q} AS q), s AS (SELECT vec_id AS id, label, list_dot_product(embedding::DOUBLE[], v) - 0.5 * list_dot_product(embedding::DOUBLE[], q) AS margin
  FROM (SELECT vec_id, embedding FROM embeddings), m, a), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY margin DESC, label) AS rank FROM s WHERE margin >= 0.13)
SELECT id, label, round(margin, 6) AS margin, round({CONFIDENCE.format(m="margin")}, 5) AS confidence, rank FROM r WHERE rank <= 3""")
def zero_shot_margin(spark: SparkSession, d: str) -> DataFrame:
    """Label centroids as vocabulary, the query vector as the one anchor."""
    found = learn.zero_shot(_vectors(spark, d).select("id", "embedding"), _vocabulary(spark, d), [B.query_vector(spark, d)])
    return found.select("id", "label", F.round("margin", 6).alias("margin"), F.round("confidence", 5).alias("confidence"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT event_id, round({CONFIDENCE.format(m='(value / 1000)')}, 6) AS confidence FROM events")
def label_confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(T.confidence(F.col("value") / 1000), 6).alias("confidence"))


SOURCES = ("manual", "exemplar", "propagated", "ocr", "vision", "prompt", None)
TAGGED = "SELECT event_id AS id, user_id AS owner, ['manual', 'exemplar', 'propagated', 'ocr', 'vision', 'prompt', NULL][1 + event_id % 7] AS source, event_type AS label, round(value / 500, 4) AS score FROM events"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in SOURCES])
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("source"), F.col("event_type").alias("label"), F.round(F.col("value") / 500, 4).alias("score"))


LISTS = f"r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY id) AS p FROM ({TAGGED})), few AS (SELECT * FROM r)"


@query(f"""WITH {LISTS}, t AS (SELECT owner, bool_or(coalesce(source IN ('manual', 'ocr', 'exemplar', 'propagated'), false)) AS sure, max(CASE WHEN source IS DISTINCT FROM 'vision' THEN score END) AS best FROM few GROUP BY owner)
SELECT owner, CASE WHEN sure OR best >= 0.56 THEN 'recognized' WHEN best > 0 THEN 'weak' ELSE 'unknown' END AS tier FROM t""")
def recognition_tier(spark: SparkSession, d: str) -> DataFrame:
    return merge.tag_tiers(_tagged(spark, d))


RANKED = "CASE source WHEN 'manual' THEN 6 WHEN 'exemplar' THEN 5 WHEN 'propagated' THEN 4 WHEN 'ocr' THEN 3 WHEN 'vision' THEN 2 ELSE 1 END"


@query(f"""WITH {LISTS}, b AS (SELECT *, {RANKED} AS k, row_number() OVER (PARTITION BY owner, label ORDER BY {RANKED} DESC, score DESC, p DESC) AS best, min(p) OVER (PARTITION BY owner, label) AS place FROM few),
s AS (SELECT owner, label, source, k, score, place, coalesce(source IN ('manual', 'exemplar', 'propagated'), false) AS durable FROM b WHERE best = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY owner, durable ORDER BY k DESC, score DESC, place) AS n FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY durable DESC, n) AS pos FROM o WHERE durable OR n <= 2)
SELECT owner, pos - 1 AS pos, label, source, score FROM w""")
def tag_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge.merged_tags(_tagged(spark, d), 2).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {LISTS}, b AS (SELECT *, row_number() OVER (PARTITION BY owner, label ORDER BY p) AS first FROM few)
SELECT owner, label, score FROM b WHERE first = 1""")
def tag_normalize(spark: SparkSession, d: str) -> DataFrame:
    return merge.first_tags(_tagged(spark, d))


@query("SELECT source AS label, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, label LIMIT 40")
def tag_histogram(spark: SparkSession, d: str) -> DataFrame:
    tag = F.struct(F.col("source").alias("label"))
    return mining.tag_histogram(table(spark, d, "documents").select(F.array(tag).alias("tags")))


@query("""SELECT d.source AS label, count(*) FILTER (WHERE quality = 1) AS positives, count(*) FILTER (WHERE quality = 0) AS negatives, count(DISTINCT d.doc_id) AS tagged, bool_or(toxic = 1) AS any_toxic, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs
FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY d.source""")
def label_rollup(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.groupBy(F.col("source").alias("label")).agg(
        F.count_if(F.col("quality") == 1).alias("positives"), F.count_if(F.col("quality") == 0).alias("negatives"), F.count_distinct("doc_id").alias("tagged"), F.bool_or(F.col("toxic") == 1).alias("any_toxic"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"),
    )


@query(f"""WITH {LISTS}, said AS (SELECT a.owner, a.p, a.label, EXISTS (SELECT 1 FROM few b WHERE b.owner = a.owner AND coalesce(b.source, '') <> 'manual' AND contains(b.label, a.label)) AS ok FROM few a WHERE a.source = 'manual')
SELECT label, count(*) AS asserted, count(*) FILTER (WHERE ok) AS agreed FROM said GROUP BY label""")
def tag_agreement(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.agreement_rows(_tagged(spark, d))


@query(f"""WITH {LISTS}, n AS (SELECT count(DISTINCT owner) AS n FROM few), k(word, facet) AS (VALUES ('click', 'action'), ('view', 'action'), ('error', 'emotion'), ('signup', 'topic'))
SELECT facet, count(DISTINCT owner) AS items, round(count(DISTINCT owner) / any_value(n.n), 6) AS share FROM few JOIN k ON label = word, n GROUP BY facet""")
def facet_coverage(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([("click", "action"), ("view", "action"), ("error", "emotion"), ("signup", "topic")], "word string, facet string")
    found = mining.facet_coverage_rows(_tagged(spark, d).select(F.col("owner").alias("id"), "label"), words)
    return found.select("facet", "items", F.round("share", 6).alias("share"))


@query(None)
def fit_heads(spark: SparkSession, d: str) -> DataFrame:
    """A logistic head for each label, from all its vectors, against a bounded background."""
    v = _vectors(spark, d)
    background = [r[0] for r in v.orderBy(F.xxhash64("id"), "id").limit(250).select("embedding").collect()]
    examples = learn.capped_examples(v.limit(0).select(F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"), F.lit(True).alias("positive")), v.select(F.col("label").cast("string").alias("label"), "id", F.col("embedding").cast("array<double>").alias("vector")))
    mean = v.select(*[F.avg(F.get("embedding", F.lit(i))) for i in range(len(background[0]) if background else 0)]).first()
    heads = learn.train_heads(examples, background, list(mean))
    return heads.select("label", F.size("weights").alias("size"), F.round("threshold", 4).alias("threshold"), F.size("positives").alias("positives"))
