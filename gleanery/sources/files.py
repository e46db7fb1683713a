"""Media listings, dataset readers, teaching packs, error logs, zip plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text

PACK = "struct<version:int,model:string,dim:int,name:string,exemplars:array<struct<label:string,category:string,vector:array<double>,associations:array<string>,positive:boolean>>>"


def media(spark: SparkSession, folder: str) -> DataFrame:
    """uri, name, kind, modified_at, length of the folder's own media files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "modificationTime", "length")
    named = files.select(F.col("path").alias("uri"), F.substring_index("path", "/", -1).alias("name"), F.unix_millis("modificationTime").alias("modified_at"), "length")
    return named.withColumn("kind", text.media_kind("name")).filter("kind is not null")


def new_files(listed: DataFrame, items: DataFrame) -> DataFrame:
    """Listed files that no finished item has, placeholders first."""
    done = items.filter("not pending").select("uri")
    waiting = items.filter("pending").select("uri", F.lit(True).alias("_waiting"))
    return listed.join(done, "uri", "left_anti").join(waiting, "uri", "left").orderBy(F.coalesce("_waiting", F.lit(False)).desc(), "name").drop("_waiting")


def image_tags(spark: SparkSession, jsonl: str, array_json: str) -> DataFrame:
    """image and its distinct tags from a JSON-lines file (image, suffix: a comma list) and a JSON array (image, tags)."""
    lines = spark.read.schema("image string, prefix string, suffix string").json(jsonl).select("image", F.explode(F.split("suffix", ",")).alias("tag"))
    listed = spark.read.option("multiLine", True).schema("image string, tags array<string>, file string").json(array_json).select("image", F.explode("tags").alias("tag"))
    both = lines.unionByName(listed).select("image", F.trim("tag").alias("tag")).filter("tag <> '' and image is not null")
    return both.groupBy("image").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def parse_pack(packs: DataFrame, model: str, dim: int, column: str = "value") -> DataFrame:
    """Exemplars of teaching packs in the given vector space; vectors of another length or with non-numbers go."""
    parsed = packs.select(F.from_json(column, PACK).alias("p")).filter((F.col("p.model") == model) & (F.col("p.dim") == dim))
    rows = parsed.select(F.col("p.name").alias("pack"), F.explode("p.exemplars").alias("e"))
    fine = (F.size("e.vector") == dim) & F.forall("e.vector", lambda x: x.isNotNull() & ~F.isnan(x))
    return rows.filter(fine & (F.coalesce("e.label", F.lit("")) != "")).select("pack", text.label("e.label").alias("label"), F.coalesce("e.category", F.lit("topic")).alias("category"), "e.vector", F.coalesce("e.associations", F.array().cast("array<string>")).alias("associations"), F.coalesce("e.positive", F.lit(True)).alias("positive"))


def pack_json(exemplars: DataFrame, name: str, model: str, dim: int) -> DataFrame:
    """One JSON text for each pack's exemplars. A pack is what one user taught; it is one document by definition."""
    entry = F.struct("label", "category", "vector", "associations", "positive")
    body = exemplars.agg(F.array_sort(F.collect_list(entry)).alias("exemplars"))
    return body.select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit(model).alias("model"), F.lit(dim).alias("dim"), F.lit(name).alias("name"), "exemplars")).alias("value"))


def zip_plan(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """path, name, verdict of a zip's files: import, duplicate (of an earlier entry or an existing name) or unsupported. ``entries``: ord, path, is_dir."""
    named = entries.filter(~F.col("is_dir")).withColumn("name", F.substring_index("path", "/", -1)).filter("name <> ''")
    first = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    joined = named.withColumn("_r", first).join(existing.select("name", F.lit(True).alias("_known")).distinct(), "name", "left")
    verdict = F.when(text.media_kind("name").isNull(), "unsupported").when((F.col("_r") > 1) | F.col("_known"), "duplicate").otherwise("import")
    return joined.select("ord", "path", "name", verdict.alias("verdict"))


def latest_errors(log: DataFrame, limit: int | None = None) -> DataFrame:
    """The last error of each (name, stage), newest first."""
    last = F.row_number().over(Window.partitionBy("name", "stage").orderBy(F.desc("created_at"), F.desc("id")))
    rows = log.withColumn("_r", last).filter("_r = 1").drop("_r").orderBy(F.desc("created_at"), F.desc("id"))
    return rows if limit is None else rows.limit(limit)


def fresh_name(names: DataFrame, taken: DataFrame) -> DataFrame:
    """name and the first free form of it: itself, or with -2, -3, ... before its ending. Numbered forms are free of ``names`` too, so no two names get the same."""
    pattern = r"^(.*)-([1-9][0-9]{0,8})(\.[^.]*)?$"
    part = lambda i: F.regexp_extract("name", pattern, i)
    numbered = taken.select("name").union(names.select("name")).distinct().filter(F.col("name").rlike(pattern)).select(part(1).alias("_s"), part(2).cast("int").alias("_n"), part(3).alias("_e")).filter("_n > 1")
    # Numbers from 2 on without a gap are one more than their place.
    placed = numbered.withColumn("_p", F.row_number().over(Window.partitionBy("_s", "_e").orderBy("_n")) + 1)
    gaps = placed.groupBy("_s", "_e").agg(F.coalesce(F.min(F.when(F.col("_n") != F.col("_p"), F.col("_p"))), F.max("_n") + 1).alias("_g"))
    stem, end = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    asked = names.select("name").distinct().select("name", stem.alias("_s"), end.alias("_e")).join(taken.select("name", F.lit(True).alias("_t")).distinct(), "name", "left").join(gaps, ["_s", "_e"], "left")
    return asked.select("name", F.when(F.col("_t"), F.concat("_s", F.lit("-"), F.coalesce("_g", F.lit(2)).cast("string"), "_e")).otherwise(F.col("name")).alias("free"))


def orphans(listed: DataFrame, referenced: Column | DataFrame, key: str = "uri") -> DataFrame:
    """Listed files nothing refers to."""
    return listed.join(referenced, key, "left_anti")
