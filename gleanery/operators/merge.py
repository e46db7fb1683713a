"""Merges without MERGE INTO: full outer joins with a rule for each column, and what is derived from the lifecycle columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import tags, text

FAILED = "failed"
STAMP = "failed:"


def upsert(live: DataFrame, new: DataFrame, key: str, rules: dict[str, Column], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Rows of both by ``key``. Where a key is in both, a column takes its rule (written with live.c and new.c), else the live value; a new row takes its own or a default."""
    defaults = defaults or {}
    a, b = live.alias("live"), new.alias("new")
    joined = a.join(b, F.col(f"live.{key}") == F.col(f"new.{key}"), "full_outer")
    in_live, in_new = F.col(f"live.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()
    out = [F.coalesce(f"live.{key}", f"new.{key}").alias(key)]
    for c, kind in live.dtypes:
        if c != key:
            own = F.col(f"new.{c}") if c in new.columns else defaults.get(c, F.lit(None)).cast(kind)
            both = rules.get(c, F.col(f"live.{c}"))
            out.append(F.when(in_live & in_new, both).when(in_live, F.col(f"live.{c}")).otherwise(own).alias(c))
    return joined.select(*out)


def live(c: str) -> Column:
    return F.col(f"live.{c}")


def new(c: str) -> Column:
    return F.col(f"new.{c}")


def index_upsert(items: DataFrame, scanned: DataFrame) -> DataFrame:
    """What indexing a file again changes: derived columns are refreshed, captions and transcripts stay, a poster is kept unless there is a new one."""
    rules = {c: new(c) for c in ("name", "kind", "embedding", "visual_embedding", "visual_model", "ocr_text", "tags", "extra_terms", "indexed_at", "modified_at") if c in items.columns and c in scanned.columns}
    rules |= {"pending": F.lit(False), "thumb_uri": F.when(new("thumb_uri") == "", live("thumb_uri")).otherwise(new("thumb_uri"))}
    rules |= {"vision_state": F.when(live("caption") == "", new("vision_state")).otherwise(live("vision_state")), "audio_state": F.when(live("audio_state") == "done", "done").otherwise(new("audio_state"))}
    return upsert(items, scanned, "uri", {c: r for c, r in rules.items() if c in items.columns}, {"caption": F.lit(""), "transcript": F.lit(""), "pending": F.lit(False)})


def additive_restore(items: DataFrame, saved: DataFrame) -> DataFrame:
    """What a restore fills: only columns that are empty in the live row. Doing it again changes nothing."""
    fill = lambda c, empty: F.when(empty, new(c)).otherwise(live(c))
    rules = {c: fill(c, live(c) == "") for c in ("ocr_text", "caption", "transcript", "extra_terms")}
    rules |= {"tags": fill("tags", live("tags").isin("", "[]")), "caption_embedding": fill("caption_embedding", live("caption_embedding").isNull()), "embedding": fill("embedding", F.size(live("embedding")) == 0)}
    rules |= {c: fill(c, live("visual_embedding").isNull()) for c in ("visual_embedding", "visual_model")} if "visual_embedding" in items.columns else {}
    rules |= {"vision_state": fill("vision_state", live("caption") == ""), "audio_state": F.when(live("audio_state") == "done", "done").otherwise(new("audio_state")), "modified_at": fill("modified_at", live("modified_at") == 0)}
    if "embedding" in items.columns:
        rules["pending"] = F.when((F.size(live("embedding")) > 0) | (F.size(new("embedding")) > 0), F.lit(False)).otherwise(live("pending"))
    return upsert(items, saved, "uri", {c: r for c, r in rules.items() if c in items.columns})


def restore_counts(items: DataFrame, saved: DataFrame) -> DataFrame:
    """added and enriched, told apart by what was there before."""
    flagged = saved.select("uri").join(items.select("uri", F.lit(True).alias("_live")), "uri", "left")
    return flagged.agg(F.count_if(F.col("_live").isNull()).alias("added"), F.count_if(F.col("_live").isNotNull()).alias("enriched"))


def keep_latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, the first in the order of the other columns (those that have an order)."""
    order = [F.col(c) for c, t in df.dtypes if c not in keys and "map" not in t and "variant" not in t] or [F.lit(0)]
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_first = 1").drop("_first")


def insert_missing(items: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``items`` with the rows of ``more`` whose key is new; of repeated keys the first stays (see first_rows)."""
    return items.unionByName(first_rows(more, [key]).join(items.select(key), key, "left_anti"), allowMissingColumns=True)


def delete(items: DataFrame, gone: DataFrame, key: str, *dependents: tuple[DataFrame, str]) -> list[DataFrame]:
    """``items`` and the tables that depend on it (by their own key's name) without the keys of ``gone``."""
    out = [items.join(gone.select(key), key, "left_anti")]
    return out + [d.join(gone.select(F.col(key).alias(k)), k, "left_anti") for d, k in dependents]


def exemplar_signature(vector: Column, label: Column, positive: Column) -> Column:
    """Label, sign and the first eight components to five places."""
    return F.concat_ws("|", label, F.when(positive, "+").otherwise("-"), F.array_join(F.transform(F.slice(vector, 1, 8), lambda x: F.format_number(x.cast("double"), 5)), ","))


def import_exemplars(known: DataFrame, incoming: DataFrame, pack: str, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """The exemplars after an import, and one row of added, skipped, removed. Columns: label, vector, positive, pack."""
    kept = known.filter(F.col("pack") != pack) if replace else known
    sign = exemplar_signature(F.col("vector"), F.col("label"), F.col("positive"))
    one = incoming.withColumn("pack", F.lit(pack)).withColumn("_s", sign)
    one = first_rows(one, ["_s"])
    fresh = one.join(kept.select(sign.alias("_s")).distinct(), "_s", "left_anti").drop("_s")
    count = lambda df, c: df.agg(F.count("*").alias(c))
    totals = count(incoming, "_all").join(count(fresh, "added")).join(count(known.filter(F.col("pack") == pack), "_old"))
    return kept.unionByName(fresh), totals.select("added", (F.col("_all") - F.col("added")).alias("skipped"), (F.col("_old") if replace else F.lit(0)).alias("removed"))


def patch(records: DataFrame, patches: DataFrame, key: str, column: str) -> DataFrame:
    """``records`` with ``column`` replaced where a patch has a value."""
    p = patches.select(key, F.col(column).alias("_p"))
    return records.join(p, key, "left").withColumn(column, F.coalesce("_p", column)).select(records.columns)


def changed(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``after`` that differ from ``before`` in one of the columns, or are new."""
    a, b = before.alias("a"), after.alias("b")
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return b.join(a, F.col(f"a.{key}") == F.col(f"b.{key}"), "left").filter(F.col(f"a.{key}").isNull() | ~same).select("b.*")


QUEUES = {
    "vision": "vision_state = 'pending' and not pending and size(embedding) > 0",
    "caption_embedding": "caption <> '' and caption_embedding is null and not pending",
    "audio": "audio_state = 'pending' and not pending",
    "thumb": "kind = 'video' and thumb_uri = ''",
    "described": "vision_state = 'done' and caption <> ''",
    "pending": "pending",
}


def queue(items: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Items that wait for a step, newest first for placeholders and oldest first else."""
    rows = items.filter(QUEUES[name]).orderBy(F.desc("id") if name == "pending" else F.asc("id"))
    return rows if limit is None else rows.limit(limit)


def needs_visual(model: str) -> Column:
    """No visual vector, or one of another model, unless this model failed on it."""
    stamp = F.coalesce(F.col("visual_model"), F.lit(""))
    return (stamp != STAMP + model) & (F.col("visual_embedding").isNull() | (stamp != model))


def vision_stats(items: DataFrame) -> DataFrame:
    """All counts in one pass; they are predicates as they stand, not a partition."""
    return items.agg(
        F.count("*").alias("total"), F.count_if(F.expr("vision_state = 'done'")).alias("described"), F.count_if(F.expr("vision_state = 'pending' and not pending")).alias("waiting"),
        F.count_if(F.expr("vision_state = 'failed' and not pending")).alias("failed"), F.count_if(F.col("pending")).alias("indexing"), F.count_if(F.expr("transcript <> ''")).alias("transcribed"),
    )


def reset_failed(items: DataFrame) -> DataFrame:
    again = F.expr("vision_state = 'failed' and not pending and size(embedding) > 0")
    return items.withColumn("vision_state", F.when(again, "pending").otherwise(F.col("vision_state")))


def tag_tiers(tagged: DataFrame) -> DataFrame:
    """owner, tier: functions.tags.recognition_tier() of a row for each tag (owner, score, source)."""
    sure = F.bool_or(F.coalesce(F.col("source").isin(*tags.CERTAIN), F.lit(False)))
    best = F.max(F.when(~F.coalesce(F.col("source") == "vision", F.lit(False)), F.col("score")))
    found = tagged.groupBy("owner").agg(sure.alias("_sure"), F.coalesce(best, F.lit(0.0)).alias("_best"))
    tier = F.when(F.col("_sure") | (F.col("_best") >= tags.RECOGNIZED), "recognized").when(F.col("_best") > 0, "weak").otherwise("unknown")
    return found.select("owner", tier.alias("tier"))


def _named(tagged: DataFrame) -> DataFrame:
    return tagged.withColumn("label", text.label("label")).filter("label <> ''")


def first_tags(tagged: DataFrame) -> DataFrame:
    """owner, label, score: functions.tags.normalize() of a row for each tag (owner, id for the order, label, score)."""
    first = F.min_by(F.struct("score"), "id")
    return _named(tagged).groupBy("owner", "label").agg(first.alias("_t")).select("owner", "label", "_t.score")


def merged_tags(tagged: DataFrame, cap_auto: int = 6) -> DataFrame:
    """owner, pos, label, source, score: functions.tags.merge_durable() of a row for each tag (owner, id for the order, label, score, source).

    Tags of one label are merged by partial aggregation; only an owner's distinct labels are put in order.
    """
    rows = _named(tagged).withColumn("_k", tags.rank(F.struct("source")))
    merged = rows.groupBy("owner", "label").agg(F.max(F.struct("_k", "score", "id", "source")).alias("_t"), F.min("id").alias("_place"))
    best = merged.select("owner", "label", "_t.*", "_place").withColumn("_durable", F.coalesce(F.col("source").isin(*tags.DURABLE), F.lit(False)))
    order = [F.desc("_k"), F.desc("score"), F.asc("_place")]
    kept = best.withColumn("_n", F.row_number().over(Window.partitionBy("owner", "_durable").orderBy(*order))).filter(F.col("_durable") | (F.col("_n") <= cap_auto))
    pos = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("_durable"), "_n")) - 1
    return kept.select("owner", pos.alias("pos"), "label", "source", "score")
