"""Reads of the library that are one filter, join or fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text, vectors

#: Fixed value: items as near as this to an example count as look-alikes.
ALIKE = 0.6


def under_folder(items: DataFrame, folder: Column | str, key: str = "uri") -> DataFrame:
    """Items whose address begins with the folder's, literally: no character of it is a wildcard."""
    return items.filter(F.startswith(F.col(key), F.lit(folder) if isinstance(folder, str) else folder))


def described_tags(items: DataFrame) -> DataFrame:
    """id and the labels that the description gave, of every described item with tags (an empty list where it gave none)."""
    labels = F.transform(F.filter("tags", lambda t: t["source"] == "vision"), lambda t: t["label"])
    return items.filter((F.col("vision_state") == "done") & (F.size("tags") > 0)).select("id", labels.alias("tags"))


def taught(exemplars: DataFrame, model: str) -> DataFrame:
    """The labels taught in a space, in an order without case."""
    return exemplars.filter(F.col("model") == model).select("label").distinct().orderBy(F.lower("label"), "label")


def winners(ranked: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    """The whole rows of ranked items (key, rank), in the order of their ranks. Wide columns are read for them alone."""
    return items.join(ranked.select(key, "rank"), key).orderBy("rank")


def look_alikes(items: DataFrame, example: list[float], least: float = ALIKE, vector: str = "embedding") -> DataFrame:
    return items.filter(vectors.cosine(vector, F.array(*[F.lit(float(x)) for x in example])) >= least)


def folder_stats(items: DataFrame) -> DataFrame:
    """folder (``(none)`` if empty) and its number of items."""
    folder = F.coalesce(F.nullif(F.trim("folder"), F.lit("")), F.lit("(none)"))
    return items.groupBy(folder.alias("folder")).agg(F.count("*").alias("items"))


def harvest_stats(items: DataFrame, noise: tuple[str, ...] = ()) -> DataFrame:
    """One row: items, folders, tagged and their share. A tag of ``noise`` alone doesn't make an item tagged."""
    real = F.exists("tags", lambda t: ~text.label(t).isin(*noise) if noise else F.lit(True))
    folder = F.nullif(F.trim("folder"), F.lit(""))
    tagged = F.count_if(F.coalesce(real, F.lit(False)))
    return items.agg(F.count("*").alias("items"), F.count_distinct(folder).alias("folders"), tagged.alias("tagged"), F.coalesce(tagged / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("tagged_share"))


def waveform_level(samples: DataFrame, key: str, value: str) -> DataFrame:
    """key, rms and peak of samples a row each; those that aren't finite count for nothing."""
    v = F.col(value).cast("double")
    fine = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return samples.groupBy(key).agg(F.coalesce(F.sqrt(F.avg(fine * fine)), F.lit(0.0)).alias("rms"), F.coalesce(F.max(F.abs(fine)), F.lit(0.0)).alias("peak"))


def label_terms(label: Column | str, associations: Column | str) -> Column:
    """A label and its associations in normal form, each once, none empty."""
    every = F.concat(F.array(vectors.col(label)), F.coalesce(vectors.col(associations), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(every, text.label), lambda t: t != ""))


def match_string(exact: Column | str, expanded: Column | str) -> Column:
    """Quoted terms of both lists joined by OR, each once; quotes in a term are doubled."""
    every = F.array_distinct(F.filter(F.transform(F.concat(vectors.col(exact), F.coalesce(vectors.col(expanded), F.array().cast("array<string>"))), text.label), lambda t: t != ""))
    return F.array_join(F.transform(every, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")
