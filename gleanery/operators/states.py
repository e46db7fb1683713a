"""State changes of items, exemplars and label vectors: a table of changes meets a table of rows, and what was there before stays elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import tags as T
from gleanery.functions import text


def changed_by(items: DataFrame, changes: DataFrame, rules: dict[str, Column], key: str = "id", only: Column | None = None) -> DataFrame:
    """``items`` with the columns of ``rules`` (written with change.c) where a change has the row's key; of several changes of one key the last by ``at`` counts, if there is such a column."""
    own = changes
    if "at" in changes.columns:
        own = changes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at")))).filter("_r = 1").drop("_r", "at")
    met = items.alias("item").join(own.withColumn("_hit", F.lit(True)).alias("change"), F.col(f"item.{key}") == F.col(f"change.{key}"), "left")
    hit = F.coalesce(F.col("change._hit"), F.lit(False)) & (F.lit(True) if only is None else only)
    return met.select(*[F.when(hit, rules[c]).otherwise(F.col(f"item.{c}")).alias(c) if c in rules else F.col(f"item.{c}") for c in items.columns])


def set_vision(items: DataFrame, results: DataFrame) -> DataFrame:
    """A description's result (id, caption, caption_embedding, tags, extra_terms) replaces what was there, tags in normal form; the state is done."""
    new = {c: F.col(f"change.{c}") for c in ("caption", "caption_embedding", "extra_terms") if c in items.columns}
    if "tags" in items.columns:
        new["tags"] = T.normalize(F.col("change.tags"))
    return changed_by(items, results, new | {"vision_state": F.lit("done")})


def requeue_vision(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items wait for a description again, without caption and its vector; tags stay."""
    rules = {"vision_state": F.lit("pending"), "caption": F.lit(""), "caption_embedding": F.lit(None)}
    return changed_by(items, ids.select("id").distinct(), {c: r for c, r in rules.items() if c in items.columns})


def set_transcript(items: DataFrame, results: DataFrame) -> DataFrame:
    """A transcript (id, transcript) that may be empty; the state is done either way."""
    return changed_by(items, results, {"transcript": F.col("change.transcript"), "audio_state": F.lit("done")})


def requeue_transcript(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Videos wait for a transcript again, without the old one."""
    return changed_by(items, ids.select("id").distinct(), {"transcript": F.lit(""), "audio_state": F.lit("pending")}, only=F.col("item.kind") == "video")


def cleared(items: DataFrame, hashes: DataFrame, settings: DataFrame, stamp: str = "index_model") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items and hashes without rows, settings without the index's stamp. Exemplars aren't touched."""
    return items.filter("false"), hashes.filter("false"), settings.filter(F.col("key") != stamp)


def add_exemplars(exemplars: DataFrame, taught: DataFrame, model: str) -> DataFrame:
    """``exemplars`` with what a user taught (label, category, vector, associations, source_uri, positive): labels in normal form, of no pack, in the space of ``model``."""
    positive = F.coalesce("positive", F.lit(True)) if "positive" in taught.columns else F.lit(True)
    own = taught.withColumns({"label": text.label("label"), "positive": positive, "origin": F.lit("self"), "pack": F.lit(""), "model": F.lit(model)})
    return exemplars.unionByName(own, allowMissingColumns=True)


def migrate_exemplars(exemplars: DataFrame, items: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Exemplars of other spaces take the vector that their source item has now; and one row of migrated and unmigratable.

    Columns: id, label, source_uri, positive, vector, model and any others; items: uri, embedding, pending. A migrated one goes where an equal one (label, source, sign) of this
    space exists; of several equal ones the least id stays. Those without a source item that has a vector stay as they are.
    """
    stale = (F.col("model") != model) & (F.coalesce("source_uri", F.lit("")) != "")
    sources = items.filter(~F.col("pending") & (F.size("embedding") > 0)).select(F.col("uri").alias("source_uri"), F.col("embedding").alias("_v"))
    met = exemplars.join(sources, "source_uri", "left").withColumn("_moves", stale & F.col("_v").isNotNull())
    same = ["_label", "source_uri", "positive"]
    moving = met.filter("_moves").withColumn("_label", text.label("label"))
    known = exemplars.filter(F.col("model") == model).select(F.col("label").alias("_label"), "source_uri", "positive").distinct()
    first = moving.withColumn("_r", F.row_number().over(Window.partitionBy(*same).orderBy("id"))).filter("_r = 1").join(known, same, "left_anti")
    fresh = first.withColumns({"label": F.col("_label"), "vector": F.col("_v"), "model": F.lit(model)})
    counts = met.agg(F.count_if("_moves").alias("migrated"), F.count_if(~F.col("_moves") & (F.col("model") != model)).alias("unmigratable"))
    return met.filter("not _moves").select(exemplars.columns).unionByName(fresh.select(exemplars.columns)), counts


def put_label_vectors(known: DataFrame, more: DataFrame) -> DataFrame:
    """(label, model, vector): a new vector takes the place of the old one; of several new ones the last by ``at``."""
    last = more.withColumn("_r", F.row_number().over(Window.partitionBy("label", "model").orderBy(F.desc("at")))).filter("_r = 1").select("label", "model", "vector")
    return known.join(last, ["label", "model"], "left_anti").select("label", "model", "vector").unionByName(last)


def reset_transcripts(items: DataFrame, failed_only: bool = False) -> DataFrame:
    """Every indexed video waits for a transcript again, without the old one; or only failed rows do, with all else as it is."""
    if failed_only:
        return items.withColumn("audio_state", F.when(F.col("audio_state") == "failed", "pending").otherwise(F.col("audio_state")))
    again = (F.col("kind") == "video") & ~F.col("pending")
    return items.withColumns({"audio_state": F.when(again, "pending").otherwise(F.col("audio_state")), "transcript": F.when(again, "").otherwise(F.col("transcript"))})
