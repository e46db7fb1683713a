"""Facets of tags: which of a vocabulary's facets a label belongs to, the best one, and how well a library is covered.

A vocabulary is two small tables: words (word, facet) that meet a label's words in an equi-join, and phrases (phrase, facet) that a label contains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text

#: First characters by which phrases meet labels.
GRAM = 3
#: Fixed value: facets in the order in which one is chosen.
PRIORITY = ("character", "person", "format", "action", "object", "setting", "situation", "emotion", "tone", "topic")
#: Fixed value: the facet that exemplars were filed under before.
OLD_FACET = "character"


def tag_facets(labels: DataFrame, words: DataFrame, phrases: DataFrame) -> DataFrame:
    """label (as it is) and facet, each pair once; labels without a facet don't appear.

    A phrase counts wherever it stands in a label, in the middle of words too. Phrases meet labels by their first characters, GRAM at most, and are then looked for, so any number of them is joined, not tried one by one.
    """
    own = labels.select("label").distinct().withColumn("_t", text.label("label")).filter("_t <> ''")
    by_word = own.select("label", F.explode(F.array_distinct(F.split("_t", "[^a-z0-9]+"))).alias("word")).join(words.select("word", "facet"), "word").select("label", "facet")
    known = phrases.select("phrase", "facet").filter("phrase <> ''").withColumn("_g", F.substring("phrase", 1, GRAM))
    starts = F.sequence(F.lit(1), F.length("_t"))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(F.col("_t"), i, F.lit(n)) for n in range(1, GRAM + 1)]))))
    by_phrase = own.withColumn("_g", F.explode(grams)).join(known, "_g").filter(F.contains("_t", "phrase")).select("label", "facet")
    return by_word.union(by_phrase).distinct()


def guessed(labels: DataFrame, words: DataFrame, phrases: DataFrame, fallback: str = OLD_FACET) -> DataFrame:
    """label and its one facet: the first of PRIORITY it has, else ``fallback``."""
    place = F.array_position(F.array(*[F.lit(f) for f in PRIORITY]), F.col("facet"))
    best = tag_facets(labels, words, phrases).withColumn("_p", place).filter("_p > 0").groupBy("label").agg(F.min_by("facet", "_p").alias("facet"))
    return labels.select("label").distinct().join(best, "label", "left").select("label", F.coalesce("facet", F.lit(fallback)).alias("facet"))


def refaceted(exemplars: DataFrame, words: DataFrame, phrases: DataFrame) -> DataFrame:
    """``exemplars`` whose category is the old one take the facet that their label points to; all others stay."""
    old = F.col("category") == OLD_FACET
    known = guessed(exemplars.filter(old), words, phrases).withColumnRenamed("facet", "_f")
    return exemplars.join(known, "label", "left").withColumn("category", F.when(old, F.coalesce("_f", "category")).otherwise(F.col("category"))).select(exemplars.columns)


def summary(items: DataFrame, words: DataFrame, phrases: DataFrame) -> DataFrame:
    """One row of items (id, tags: labels): n, avg_facets, avg_tags, unclassified (the share of tags without a facet). Zeros for an empty table."""
    tags = items.select("id", F.explode("tags").alias("label"))
    facets = tag_facets(tags, words, phrases)
    per_label = facets.groupBy("label").agg(F.count("*").alias("_n"))
    loose = tags.join(per_label, "label", "left_anti").agg(F.count("*").alias("_loose"))
    covered = tags.join(facets, "label").select("id", "facet").distinct().agg(F.count("*").alias("_facets"))
    whole = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tags")), F.lit(0)).alias("_tags"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    one = whole.join(F.broadcast(covered), F.lit(True)).join(F.broadcast(loose), F.lit(True))
    return one.select("n", share("_facets", "n").alias("avg_facets"), share("_tags", "n").alias("avg_tags"), share("_loose", "_tags").alias("unclassified"))


def by_priority(facets: DataFrame) -> DataFrame:
    """label and its facets in the order of PRIORITY."""
    place = F.array_position(F.array(*[F.lit(f) for f in PRIORITY]), F.col("facet"))
    return facets.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(place, "facet")))
