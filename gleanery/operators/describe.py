"""Descriptions: what a vision model is told beforehand, and its replies for the frames of one item as one description."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import replies

#: Order of facets, labels a facet, labels in all, related terms.
FACETS = ("format", "character", "person", "action", "object", "setting", "emotion", "situation", "tone", "topic")
PER_FACET, LABELS, RELATED = 2, 8, 6


@dataclass(frozen=True)
class Wording:
    """Texts around the labels, by how sure the recogniser is; ``nothing`` is said where it has no labels."""

    nothing: str = "No known format was recognised. Name only what is certain, and describe what happens and when one would send it."
    sure: tuple[str, str] = ("A recogniser suggests: ", ". Use what fits and ignore the rest.")
    unsure: tuple[str, str] = ("A recogniser is unsure and only guesses: ", ". Use a guess only if it is plainly right.")
    related: tuple[str, str] = (" (related: ", ")")


def first_of_each(rows: DataFrame, keys: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """The first row of each ``keys`` by ``order``, and of those the first ``most`` of each first key. Ranks are cut in each task before the shuffle."""
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
    if most is None:
        return one
    return one.withColumn("_r", F.row_number().over(Window.partitionBy(keys[0]).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def grounding(items: DataFrame, labels: DataFrame, related: DataFrame, wording: Wording = Wording()) -> DataFrame:
    """id and the text that tells a model what was recognised: labels by facet, PER_FACET each and LABELS in all, then RELATED terms.

    items: id, tier (``recognized``, ``weak``, ``unknown``). labels: id, label, category, position. related: id, term, position. A label counts once, by its first place; facets out of FACETS come last, in order of their first label. Quotas
    are ranks within an item and facet and within an item, so no item's labels are collected before they are cut.
    """
    named = labels.withColumn("label", F.trim("label")).filter("label <> ''").withColumns({"_key": F.lower("label"), "category": F.coalesce("category", F.lit(""))})
    one = first_of_each(named, ["id", "_key"], ["position", "label"])
    by_facet = Window.partitionBy("id", "category").orderBy("position", "label")
    few = one.withColumn("_n", F.row_number().over(by_facet)).filter(F.col("_n") <= PER_FACET).drop("_n")
    place = F.array_position(F.array(*[F.lit(f) for f in FACETS]), F.col("category"))
    placed = few.withColumns({"_facet": F.when(place > 0, place).otherwise(len(FACETS) + 1), "_first": F.min("position").over(Window.partitionBy("id", "category"))})
    order = ["_facet", "_first", "category", "position", "label"]
    kept = placed.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter(F.col("_n") <= LABELS)
    rows = kept.groupBy("id", "category").agg(F.min("_n").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "label"))), lambda x: x["label"]), ", ").alias("_l"))
    segments = rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat("category", F.lit(": "), "_l").alias("s")))), lambda x: x["s"]), "; ").alias("_s"))
    terms = related.withColumn("term", F.lower(F.trim("term"))).filter("term <> ''")
    near = first_of_each(terms, ["id", "term"], ["position", "term"], RELATED).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda x: x["term"]), ", ").alias("_t"))
    joined = items.join(segments, "id", "left").join(near, "id", "left")
    more = F.when(F.col("_t").isNotNull(), F.concat(F.lit(wording.related[0]), "_t", F.lit(wording.related[1]))).otherwise("")
    said = lambda words: F.concat(F.lit(words[0]), "_s", more, F.lit(words[1]))
    nothing = (F.col("tier") == "unknown") | F.col("_s").isNull()
    return joined.select("id", F.when(nothing, wording.nothing).when(F.col("tier") == "weak", said(wording.unsure)).otherwise(said(wording.sure)).alias("grounding"))


def _union(rows: DataFrame, column: str) -> DataFrame:
    """id and up to ITEMS of a list column's values over all frames, each once whatever its case, in order."""
    values = rows.select("id", "ordinal", F.posexplode(column).alias("_p", "_v")).withColumn("_v", F.trim("_v")).filter("_v <> ''").withColumn("_k", F.lower("_v"))
    few = first_of_each(values, ["id", "_k"], ["ordinal", "_p", "_v"], replies.ITEMS)
    return few.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "_p", "_v"))), lambda x: x["_v"]).alias(column))


def _texts(rows: DataFrame) -> DataFrame:
    """id and the frames' writings that no other contains, one a line. Of writings that differ in case alone the first stays.

    What is contained in a longer one is found by a fold over an item's distinct writings, longest first; a clip has some dozens.
    """
    plain = rows.select("id", "ordinal", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("_t")).filter("_t <> ''").withColumn("_k", F.lower("_t"))
    one = first_of_each(plain, ["id", "_k"], ["ordinal", "_t"])
    long_first = F.array_sort(F.collect_list(F.struct((-F.length("_k")).alias("_n"), "ordinal", "_t", "_k")))
    kind = "array<struct<_n:int,ordinal:bigint,_t:string,_k:string>>"
    none = F.array().cast(kind)
    fold = lambda xs: F.aggregate(xs, none, lambda kept, x: F.when(F.exists(kept, lambda k: F.contains(k["_k"], x["_k"])), kept).otherwise(F.concat(kept, F.array(x))))
    listed = one.withColumn("ordinal", F.col("ordinal").cast("long")).groupBy("id").agg(long_first.alias("_x")).withColumn("_x", F.col("_x").cast(kind))
    return listed.select("id", F.array_join(F.transform(F.array_sort(F.transform(fold(F.col("_x")), lambda x: F.struct(x["ordinal"], x["_t"]))), lambda x: x["_t"]), "\n").alias("text"))


def merged(frames: DataFrame) -> DataFrame:
    """id, caption, subjects, text, tags of items from their frames' descriptions (id, ordinal, caption, subjects, text, tags).

    The caption joins the first two that differ, cut at CAPTION code points; lists and writings are unions in order. An item's only frame stays as it is. Of frames with one ordinal the order is by content.
    """
    count = frames.groupBy("id").agg(F.count("*").alias("_n"), *[F.first(c).alias(f"_{c}") for c in replies.FIELDS])
    captions = frames.select("id", "ordinal", F.trim(F.coalesce("caption", F.lit(""))).alias("_v")).filter("_v <> ''").withColumn("_k", F.lower("_v"))
    few = first_of_each(captions, ["id", "_k"], ["ordinal", "_v"], replies.JOINED)
    caption = few.groupBy("id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "_v"))), lambda x: x["_v"]), " / "), 1, replies.CAPTION).alias("caption"))
    joined = count
    for part in (caption, _union(frames, "subjects"), _texts(frames), _union(frames, "tags")):
        joined = joined.join(part, "id", "left")
    none = {"caption": F.lit(""), "text": F.lit(""), "subjects": F.array().cast("array<string>"), "tags": F.array().cast("array<string>")}
    pick: list[Column] = [F.when(F.col("_n") == 1, F.col(f"_{c}")).otherwise(F.coalesce(c, none[c])).alias(c) for c in replies.FIELDS]
    return joined.select("id", *pick)
