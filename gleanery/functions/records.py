"""Records shown to a user, states of a new row, and small rules of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import vectors
from gleanery.functions.vectors import col

FAILED = "failed"


def records(items: DataFrame, with_vectors: bool = False) -> DataFrame:
    """Items with empty texts for missing ones and no poster for a failed one; vectors are left out unless asked for, so the scan never reads them."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("ocr_text", "caption", "transcript", "extra_terms")]
    more = ["embedding", "caption_embedding"] if with_vectors else []
    return items.select("id", "uri", "name", "kind", *texts, "tags", F.nullif("thumb_uri", F.lit(FAILED)).alias("thumb_uri"), "vision_state", "audio_state", "modified_at", *more)


def new_rows(scanned: DataFrame, model: str) -> DataFrame:
    """States of rows just scanned (columns of the scan and ``degraded``): a degraded row has an empty vector, failed vision and a failure stamp."""
    bad = F.coalesce("degraded", F.lit(False))
    return scanned.withColumns({
        "embedding": F.when(bad, F.array().cast("array<float>")).otherwise(F.col("embedding")), "vision_state": F.when(bad, "failed").otherwise("pending"),
        "audio_state": F.when((F.col("kind") == "video") & ~bad, "pending").otherwise("none"), "visual_model": F.when(bad, F.lit(f"{FAILED}:{model}")).otherwise(F.coalesce("visual_model", F.lit(""))),
        "pending": F.lit(False), "caption": F.lit(""), "transcript": F.lit(""),
    }).drop("degraded")


def same_record(a: str, b: str, columns: list[str]) -> Column:
    """True if two aliased rows agree; tags are compared without their scores."""
    out = F.lit(True)
    for c in columns:
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        if c == "tags":
            x, y = (F.transform(t, lambda g: g.dropFields("score")) for t in (x, y))
        out &= x.eqNullSafe(y)
    return out


def usable_vectors(model: Column, dim: Column, own_model: str, own_dim: int) -> Column:
    """Vectors of another space or length are never compared."""
    return (model == own_model) & (dim == own_dim)


def held_out(key: Column | str, parts: int = 20) -> Column:
    """True for the share of keys whose SHA-1, as a number, is divisible by ``parts`` (20): 16 leaves 1 modulo 5, so digits decide."""
    if parts != 20:
        raise ValueError("only 20 parts have a rule by digits")
    digits = F.transform(F.split(F.sha1(col(key)), ""), lambda h: F.conv(h, 16, 10).cast("int"))
    return (F.element_at(digits, -1) % 4 == 0) & (F.aggregate(digits, F.lit(0), lambda s, x: s + x) % 5 == 0)


def items_per_hour(intensity: Column | str) -> Column:
    """Six at 0, 600 at 1, without limit from 0.97 on."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(intensity)))
    return F.when(v >= 0.97, F.lit(float("inf"))).otherwise(F.round(6 * F.pow(F.lit(100.0), v)))


def luminance(color: Column | str) -> Column:
    """Relative luminance of #rrggbb."""
    part = lambda at: F.conv(F.substring(col(color), at, 2), 16, 10).cast("double") / 255
    linear = lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * linear(part(2)) + 0.7152 * linear(part(4)) + 0.0722 * linear(part(6))


def contrast(a: Column | str, b: Column | str) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def pooled_frames(frames: DataFrame) -> DataFrame:
    """id, embedding and ocr_text of items from their kept frames (id, ordinal, embedding, text): mean direction, and texts that no other kept text contains, in order."""
    pooled = vectors.mean_pool(frames, "embedding", ("id",)).withColumnRenamed("mean", "embedding")
    listed = frames.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.trim(F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"]).alias("_t"))
    none = F.array().cast("array<string>")
    low = F.lower
    fold = F.aggregate("_t", none, lambda kept, t: F.when((t == "") | F.exists(kept, lambda k: F.contains(low(k), low(t))), kept).otherwise(F.concat(F.filter(kept, lambda k: ~F.contains(low(t), low(k))), F.array(t))))
    return pooled.join(listed.select("id", F.array_join(fold, "\n").alias("ocr_text")), "id")
