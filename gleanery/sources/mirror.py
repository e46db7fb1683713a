"""A mirror of derived knowledge: JSON chunks by a hash of the name, rewritten only where their digest changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import hashing

VERSION = 1


def chunks(items: DataFrame, count: int = hashing.CHUNKS) -> DataFrame:
    """``items`` as (chunk, name, payload): a JSON text a row."""
    columns = [c for c in items.columns if c != "uri"]
    return items.select(hashing.chunk_of("name", count).alias("chunk"), "name", F.to_json(F.struct(*columns)).alias("payload"))


def manifest(rows: DataFrame) -> DataFrame:
    """chunk, rows, digest: digests add up two 64-bit hashes of the payloads, so they don't depend on order and need no collected chunk."""
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "name", "payload").cast("decimal(38,0)")).cast("string")
    return rows.groupBy("chunk").agg(F.count("*").alias("rows"), F.concat_ws(":", total(1), total(2)).alias("digest"))


def changed_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    """Chunks to write again: those with another digest, and those that are empty now."""
    fresh = new.join(old.select("chunk", "digest"), ["chunk", "digest"], "left_anti").select("chunk")
    return fresh.union(old.join(new.select("chunk"), "chunk", "left_anti").select("chunk"))


def sync(items: DataFrame, path: str) -> DataFrame:
    """Write what changed under ``path`` and return the manifest. A failed run leaves the old manifest or a whole next one, so the next run repeats its work or finds it done."""
    spark = items.sparkSession
    rows = chunks(items)
    new = manifest(rows)
    old = read_manifest(spark, path)
    todo = new if old is None else changed_chunks(new, old)
    spark_rows = rows.join(todo.select("chunk"), "chunk", "left_semi")
    spark_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").json(f"{path}/chunks")
    kept = new.withColumn("version", F.lit(VERSION))
    kept.coalesce(1).write.mode("overwrite").json(f"{path}/manifest-next")
    settled = spark.read.schema(kept.schema).json(f"{path}/manifest-next")
    settled.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return settled


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest, or the next one where a run ended while it took the manifest's place."""
    jvm = spark.sparkContext._jvm
    for name in ("manifest", "manifest-next"):
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return spark.read.schema("chunk string, rows long, digest string, version int").json(f"{path}/{name}").filter(F.col("version") <= VERSION)
    return None


def restore(spark: SparkSession, path: str, files: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Restored rows with the uri their name has now, and one row of restored, orphaned and unreadable counts."""
    rows = spark.read.schema("name string, payload string, chunk string").json(f"{path}/chunks")
    live = read_manifest(spark, path)
    if live is not None:
        rows = rows.join(F.broadcast(live.select("chunk")), "chunk", "left_semi")
    parsed = rows.withColumn("_p", F.from_json("payload", schema)).join(files.groupBy("name").agg(F.max("uri").alias("uri")), "name", "left")
    fine = F.col("_p.name").isNotNull()
    counts = parsed.agg(F.count_if(fine & F.col("uri").isNotNull()).alias("restored"), F.count_if(fine & F.col("uri").isNull()).alias("orphaned"), F.count_if(~fine).alias("unreadable"))
    return parsed.filter(fine & F.col("uri").isNotNull()).select("uri", "_p.*"), counts


def collection(items: DataFrame, path: str) -> None:
    """The collection's manifest as JSON lines, a part a task."""
    items.filter("not pending").select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
