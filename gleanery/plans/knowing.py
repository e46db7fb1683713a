"""Scoring items by a whole model, and retagging a library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import tags as T
from gleanery.functions import vectors
from gleanery.operators import knowledge, merge
from gleanery.plans import bindings as B
from gleanery.plans.register import query
from gleanery.plans.tagging import CENTRES, CONFIDENCE
from gleanery.sources.tables import table

#: Documents with the vector of the same number as items: a manual tag for each third, a vision tag for each fourth, writing that a rule knows for each fifth.
ITEMS = """items AS (SELECT doc_id AS id, embedding::DOUBLE[] AS v, lang, source, CASE WHEN doc_id % 5 = 0 THEN 'gm, wagmi ' || source ELSE '' END AS ocr FROM documents JOIN embeddings ON doc_id = vec_id)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    tag = lambda label, source: F.struct(F.col(label).alias("label"), F.lit("topic").alias("category"), F.lit(1.0).alias("score"), F.lit(source).alias("source"))
    tags = F.array_compact(F.array(F.when(i % 3 == 0, tag("source", "manual")), F.when(i % 4 == 0, tag("lang", "vision")))).cast(T.TAGS)
    joined = table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return joined.select(i.alias("id"), "embedding", F.when(i % 5 == 0, F.concat(F.lit("gm, wagmi "), F.col("source"))).otherwise("").alias("ocr_text"), tags.alias("tags"), F.lit("").alias("extra_terms"))


def _model(spark: SparkSession, d: str, moved: bool = False) -> knowledge.Knowledge:
    """Label centroids as prompts and, for even labels, as taught heads; the query vector is the one anchor. Moved: label 0's prompt is label 1's."""
    centres = vectors.mean_vector(table(spark, d, "embeddings"), "embedding", ("label",)).withColumnRenamed("mean", "vector")
    named = centres.select(F.concat(F.lit("prompt "), F.col("label").cast("string")).alias("label"), F.lit("topic").alias("category"), "vector")
    if moved:
        other = named.filter("label = 'prompt 1'").select(F.lit("prompt 0").alias("label"), "category", "vector")
        named = named.filter("label <> 'prompt 0'").unionByName(other)
    heads = centres.filter("label % 2 = 0").select(F.concat(F.lit("taught "), F.col("label").cast("string")).alias("label"), F.lit("topic").alias("category"), F.transform("vector", lambda x: x * 8).alias("weights"), F.lit(-2.0).alias("bias"), F.lit(0.6).alias("threshold"), F.lit(0.0).alias("knn_mean"), F.lit(0.0).alias("knn_std"))
    anchor = spark.createDataFrame([(B.query_vector(spark, d),)], "vector array<double>")
    return knowledge.Knowledge(named, anchor, heads, spark.createDataFrame([], "label string, positive boolean, vector array<double>"), spark.createDataFrame([("prompt 1", ["first", "one"]), ("taught 0", ["zero"])], "label string, terms array<string>"))


def _seen(prompts: str, name: str) -> str:
    """The three best tags of each item by vector, and all its tags, as SQL; ``prompts`` has label and v."""
    return f"""{name}_s AS (SELECT id, 'prompt ' || label AS label, list_dot_product(i.v, p.v) - 0.5 * list_dot_product(i.v, q) AS m FROM items i, {prompts} p, a),
{name}_p AS (SELECT id, label, {CONFIDENCE.format(m="m")} AS score, 'prompt' AS source FROM {name}_s WHERE m >= 0.13),
{name}_h AS (SELECT id, 'taught ' || label AS label, 1 / (1 + exp(2 - 8 * list_dot_product(i.v, m.v))) AS score, 'exemplar' AS source FROM items i, m WHERE label % 2 = 0),
{name}_v AS (SELECT id, label, score, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source, round(score, 9) DESC, label) AS r FROM (SELECT * FROM {name}_p UNION ALL SELECT * FROM {name}_h WHERE score >= 0.6)) WHERE r <= 3),
{name}_t AS (SELECT * FROM {name}_v UNION ALL SELECT id, 'crypto / nft', 1.0, 'ocr' FROM items WHERE ocr <> '' UNION ALL SELECT id, source, 1.0, 'manual' FROM items WHERE id % 3 = 0 UNION ALL SELECT id, lang, 1.0, 'vision' FROM items WHERE id % 4 = 0),
{name} AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY source IN ('manual', 'exemplar') DESC, CASE source WHEN 'manual' THEN 6 WHEN 'exemplar' THEN 5 WHEN 'ocr' THEN 3 WHEN 'vision' THEN 2 ELSE 1 END DESC, round(score, 9) DESC, label) - 1 AS pos, label, source, round(score, 6) AS score FROM {name}_t)"""


def _listed(updates: DataFrame) -> DataFrame:
    return updates.select("id", F.posexplode("tags").alias("pos", "t")).select("id", F.col("pos").cast("long").alias("pos"), "t.label", "t.source", F.round("t.score", 6).alias("score"))


@query(f"""WITH {CENTRES}, {ITEMS}, a AS (SELECT {B.Q} AS q), {_seen("m", "t")} SELECT id, source = 'exemplar' AS taught, label, round(score, 6) AS score FROM t_v""")
def classify_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every item against every prompt and head, three labels kept."""
    found = knowledge.classify(_items(spark, d).select("id", "embedding"), _model(spark, d))
    return found.select("id", F.explode("seen").alias("t")).select("id", (F.col("t.source") == "exemplar").alias("taught"), "t.label", F.round("t.score", 6).alias("score"))


@query(f"""WITH {CENTRES}, {ITEMS}, a AS (SELECT {B.Q} AS q), {_seen("m", "t")} SELECT * FROM t""")
def retag_library(spark: SparkSession, d: str) -> DataFrame:
    """A first retag: every item with a tag is written, since its terms are new."""
    updates, _, _ = knowledge.retag(_items(spark, d), _model(spark, d), 1)
    return _listed(updates)


@query(f"""WITH {CENTRES}, {ITEMS}, a AS (SELECT {B.Q} AS q), n AS (SELECT x.label, y.v FROM m x JOIN m y ON y.label = CASE WHEN x.label = 0 THEN 1 ELSE x.label END), {_seen("m", "t")}, {_seen("n", "u")},
old AS (SELECT id, list(label || source || score ORDER BY pos) AS x FROM t GROUP BY id), new AS (SELECT id, list(label || source || score ORDER BY pos) AS y FROM u GROUP BY id), ch AS (SELECT id FROM old FULL JOIN new USING (id) WHERE x IS DISTINCT FROM y)
SELECT u.* FROM u JOIN ch USING (id)""")
def retag_changed(spark: SparkSession, d: str) -> DataFrame:
    """A second retag after one prompt changed: only items that it moves are written. Items that lose their last tag have none to list."""
    items = _items(spark, d)
    first, states, versions = knowledge.retag(items, _model(spark, d), 1)
    now = merge.patch(merge.patch(items, first, "id", "tags"), first, "id", "extra_terms")
    updates, _, _ = knowledge.retag(now, _model(spark, d, moved=True), 2, states, versions)
    return _listed(updates)
