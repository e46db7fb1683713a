"""Rollups of what a user has taught and of the library's state: each one groupBy over partial counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import hashing, text
from gleanery.operators import merge


def taught_labels(exemplars: DataFrame, items: DataFrame) -> DataFrame:
    """label, positives, negatives, tagged, from_self, from_pack, packs: examples of a label and the items that carry it."""
    taught = exemplars.groupBy("label").agg(
        F.count_if("is_positive").alias("positives"), F.count_if(~F.col("is_positive")).alias("negatives"), F.bool_or(F.col("origin") == "self").alias("from_self"), F.bool_or(F.col("origin") == "pack").alias("from_pack"),
        F.array_sort(F.collect_set(F.when(F.col("pack") != "", F.col("pack")))).alias("packs"),
    )
    carried = items.select(F.explode(F.array_distinct(F.transform("tags", lambda t: text.label(t["label"])))).alias("label")).groupBy("label").agg(F.count("*").alias("tagged"))
    return taught.join(carried, "label", "left").withColumn("tagged", F.coalesce("tagged", F.lit(0)))


def packs(exemplars: DataFrame) -> DataFrame:
    return exemplars.filter("origin = 'pack'").groupBy("pack").agg(F.count_distinct("label").alias("labels"), F.count("*").alias("examples")).orderBy("pack")


def poster_stats(items: DataFrame) -> DataFrame:
    videos = items.filter("kind = 'video'")
    counts = videos.agg(F.count("*").alias("total"), F.count_if(~F.col("thumb_uri").isin("", "failed")).alias("done"), F.count_if(F.col("thumb_uri") == "failed").alias("failed"))
    return counts.withColumn("missing", F.col("total") - F.col("done") - F.col("failed"))


def knowledge_version(exemplars: DataFrame, items: DataFrame) -> DataFrame:
    """One stamp that changes when examples or the finished items do."""
    a = exemplars.agg(F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("s"))
    b = items.filter("not pending").agg(F.count("*").alias("m"))
    return a.join(b).select(F.concat_ws(":", "n", "s", "m").alias("version"))


def manual_tag_stamp(items: DataFrame) -> DataFrame:
    """A hash of all user-made tags whatever their order: 64-bit hashes of (item, label) are added up, so nothing is collected."""
    tags = items.select("id", F.explode("tags").alias("t")).filter("t.source = 'manual'")
    return tags.agg(hashing.fnv_text(F.concat_ws("|", F.count("*"), F.coalesce(F.sum(F.xxhash64("id", text.label("t.label")).cast("decimal(38,0)")), F.lit(0)))).alias("stamp"))


def associations(*vocabularies: DataFrame) -> DataFrame:
    """label and the distinct associations any vocabulary (label, associations) gives it."""
    rows = vocabularies[0].select("label", "associations")
    for more in vocabularies[1:]:
        rows = rows.unionByName(more.select("label", "associations"))
    return rows.groupBy(text.label("label").alias("label")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("associations")))).alias("associations"))


def live_content(hashes: DataFrame, items: DataFrame) -> DataFrame:
    """Fingerprints whose item is still there."""
    return hashes.join(items.select("uri"), "uri").select("hash", "uri")


def share_dedupe(incoming: DataFrame, hashes: DataFrame) -> DataFrame:
    """Incoming files (hash, uri, name) that are new: of equal contents the first address stays, known contents go."""
    return merge.first_rows(incoming, ["hash"]).join(hashes.select("hash"), "hash", "left_anti")
