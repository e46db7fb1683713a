"""Edits over time as tables: rectangles between corrections, and the segments that ranges, cards and a speed make together.

Rectangles have a corner and a size in shares of the frame. One row a correction, range or card; an entity's rows are sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.operators import intervals
from gleanery.sources import tables

SIDES = ("x", "y", "width", "height")
#: Places of a share; least and most of the speed and of a card's duration, steps of the latter, a card's frame rate, segments of an entity.
PLACES, SPEEDS, CARD_US, CARD_STEP_US, FRAME_RATE, SEGMENTS = 12, (0.5, 2.0), (200_000, 10_000_000), 1000, 30, 96
#: Still images by ending.
STILLS = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "jfif": "image/jpeg", "webp": "image/webp", "bmp": "image/bmp", "dib": "image/bmp", "heif": "image/heif", "heic": "image/heic"}


def clamped(rect: Column) -> Column:
    """A rectangle inside the frame; a side that is no number is 0."""
    share = lambda v: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(F.coalesce(v.cast("double"), F.lit(0.0)), F.lit(0.0)))), PLACES)
    within = lambda size, corner: F.round(F.least(share(size), 1 - share(corner)), PLACES)
    return F.struct(share(rect["x"]).alias("x"), share(rect["y"]).alias("y"), within(rect["width"], rect["x"]).alias("width"), within(rect["height"], rect["y"]).alias("height"))


def rects(points: DataFrame, corrections: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """points (entity, time_us) with the rectangle there and the ``mode`` of the correction that it comes from; both null where there is none.

    corrections: entity, time_us, ordinal, x, y, width, height, easing (``linear``, or ``hold`` up to the next), mode. Outside their span the nearest holds; of one time the last by ordinal counts. ``active`` (entity, start_us,
    end_us): an entity that has such spans has rectangles only in them, ends included. A correction knows its successor before it meets the points, so one ordered pass gives both neighbours.
    """
    last = F.row_number().over(Window.partitionBy("entity", "time_us").orderBy(F.desc("ordinal")))
    one = corrections.withColumn("_r", last).filter("_r = 1").select("entity", "time_us", F.struct("time_us", *SIDES, "easing", "mode").alias("_k"))
    in_time = Window.partitionBy("entity").orderBy("time_us")
    pairs = one.select("entity", "time_us", F.struct(F.col("_k").alias("a"), F.lead("_k").over(in_time).alias("b")).alias("_p"), F.lit(0).alias("_kind"))
    asked = points.select("entity", "time_us", F.lit(None).cast(pairs.schema["_p"].dataType).alias("_p"), F.lit(1).alias("_kind"))
    upto = Window.partitionBy("entity").orderBy("time_us", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = pairs.unionByName(asked).withColumns({"_l": F.last("_p", ignorenulls=True).over(upto), "_f": F.first("_p", ignorenulls=True).over(Window.partitionBy("entity").orderBy("_kind", "time_us"))}).filter("_kind = 1")
    early = F.col("_l").isNull()
    a, b = F.when(early, F.col("_f.a")).otherwise(F.col("_l.a")), F.col("_l.b")
    progress = (F.col("time_us") - a["time_us"]) / (b["time_us"] - a["time_us"])
    still = early | b.isNull() | (a["time_us"] == F.col("time_us")) | F.coalesce(a["easing"] == "hold", F.lit(False))
    side = lambda s: F.when(still, a[s].cast("double")).otherwise(F.round(a[s] + (b[s] - a[s]) * progress, PLACES))
    shown = F.when(a.isNotNull(), clamped(F.struct(*[side(s).alias(s) for s in SIDES])))
    out = met.select("entity", "time_us", shown.alias("rect"), a["mode"].alias("mode"))
    if active is not None:
        out = _active(out, active)
    return out.select("entity", "time_us", *[F.col(f"rect.{s}").alias(s) for s in SIDES], "mode")


def _active(rows: DataFrame, active: DataFrame) -> DataFrame:
    """``rows`` without a rectangle outside an entity's spans; those without spans stay. Spans are merged first, so a row has one before it at most that can hold it."""
    spans = intervals.islands(active.withColumn("end_us", F.col("end_us") + 1))
    marks = spans.select("entity", F.col("start_us").alias("time_us"), F.col("end_us").alias("_e"), F.lit(0).alias("_kind"))
    both = rows.withColumns({"_kind": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    own = Window.partitionBy("entity")
    end = F.last("_e", ignorenulls=True).over(own.orderBy("time_us", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    there = F.count("_e").over(own) == 0
    met = both.withColumns({"_end": end, "_free": there}).filter("_kind = 1")
    inside = F.col("_free") | F.coalesce(F.col("time_us") < F.col("_end"), F.lit(False))
    return met.select("entity", "time_us", F.when(inside, F.col("rect")).alias("rect"), F.when(inside, F.col("mode")).alias("mode"))


def still_type(uri: Column) -> Column:
    """The type of a still image by its name's ending; null for any other."""
    name = F.substring_index(F.regexp_replace(uri, r"(?s)[#?].*", ""), "/", -1)
    return F.element_at(F.create_map(*[F.lit(x) for pair in STILLS.items() for x in pair]), F.when(text.ending(name) != "", text.ending(name)).otherwise("-"))


def compositions(projects: DataFrame, ranges: DataFrame, cards: DataFrame, most: int = SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """The segments of each project in order, and the reasons why a project has none.

    projects: entity, duration_us, speed. ranges: entity, start_us, end_us. cards: entity, ordinal, uri, duration_us, at_us (a time of the output without cards). Segments: entity, index, kind (``source`` or ``card``), start_us and end_us
    in the source, ordinal and type of a card, output_start_us, output_end_us. Rejections: entity, ordinal of the card if it is one's, code.

    Pieces of ranges and cards lie on one line, the retained time: a card inside a range cuts it, a card at a seam stands before the range that begins there. A running total over that line gives all output times.
    """
    lone = lambda df, code, ordinal=F.lit(None).cast("long"): df.select("entity", ordinal.alias("ordinal"), F.lit(code).alias("code"))
    fast = F.coalesce(F.col("speed").between(*SPEEDS), F.lit(False))
    ok = projects.filter(fast)
    kept = intervals.islands(ranges.join(ok.select("entity", F.greatest(F.lit(0), F.coalesce("duration_us", F.lit(0))).alias("_d")), "entity"), F.col("_d"))
    kept = tables.written(kept, "kept")
    whole = ok.join(kept.groupBy("entity").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("_kept")), "entity")
    rejected = [lone(projects.filter(~fast), "unsupported-speed"), lone(ok.join(whole.select("entity"), "entity", "left_anti"), "no-retained-ranges")]
    output = F.round(F.col("_kept") / F.col("speed")).cast("long")
    asked = cards.join(whole.select("entity", "speed", output.alias("_out")), "entity").withColumn("type", still_type(F.col("uri")))
    code = F.when(F.col("type").isNull(), "card-unsupported-asset").when(~F.coalesce(F.col("duration_us").between(*CARD_US), F.lit(False)), "card-duration-out-of-range")
    code = code.when(~F.coalesce((F.col("at_us") >= 0) & (F.col("at_us") <= F.col("_out")), F.lit(False)), "card-position-out-of-range")
    asked = tables.written(asked.withColumn("_code", code), "cards")
    rejected.append(asked.filter("_code is not null").select("entity", F.col("ordinal").cast("long").alias("ordinal"), F.col("_code").alias("code")))
    good = whole.select("entity", "speed").join(asked.filter("_code is not null").select("entity").distinct(), "entity", "left_anti")
    good = tables.written(good, "good")
    offsets = tables.written(intervals.with_offsets(kept.join(good, "entity")), "offsets")
    placed = _placed(asked.filter("_code is null").select("entity", "ordinal", "at_us", "type", F.col("duration_us").alias("_us")), offsets)
    rows = _pieces(offsets, placed).unionByName(placed.select("entity", F.col("_at").alias("at"), F.lit(0).alias("_kind"), "at_us", "ordinal", "type", (F.round(F.col("_us") / CARD_STEP_US) * CARD_STEP_US).cast("long").alias("_length")), allowMissingColumns=True)
    line = Window.partitionBy("entity").orderBy("at", "_kind", "at_us", "ordinal")
    before = F.coalesce(F.sum("_length").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumns({"index": F.row_number().over(line) - 1, "_before": before, "_n": F.count("*").over(Window.partitionBy("entity"))}).join(good, "entity")
    rejected.append(lone(out.filter(F.col("_n") > most).select("entity").distinct(), "segment-limit-exceeded"))
    at = lambda t: F.round(t / F.col("speed")).cast("long")
    segments = out.filter(F.col("_n") <= most).select("entity", "index", F.when(F.col("_kind") == 0, "card").otherwise("source").alias("kind"), "start_us", "end_us", "ordinal", "type", at(F.col("_before")).alias("output_start_us"), at(F.col("_before") + F.col("_length")).alias("output_end_us"))
    reasons = rejected[0]
    for more in rejected[1:]:
        reasons = reasons.unionByName(more)
    return segments, reasons


def _placed(cards: DataFrame, offsets: DataFrame) -> DataFrame:
    """Cards with ``_at``, their place in the retained time: where a range's output begins, or as far into the last range begun as the speed says."""
    seams = offsets.select("entity", F.round(F.col("before_us") / F.col("speed")).cast("long").alias("at"), F.struct("before_us", (F.col("end_us") - F.col("start_us")).alias("length"), "speed", F.col("is_last")).alias("_r"), F.lit(0).alias("_kind"))
    asked = cards.withColumn("at", F.col("at_us").cast("long")).withColumn("_kind", F.lit(1))
    order = Window.partitionBy("entity").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = seams.unionByName(asked, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(order)).filter("_kind = 1").filter("_r is not null")
    into = F.round(F.col("at_us") * F.col("_r.speed") - F.col("_r.before_us"))
    seam = F.col("at_us") == F.round(F.col("_r.before_us") / F.col("_r.speed"))
    inside = F.when(seam, 0).otherwise(F.greatest(F.lit(0), F.least(F.col("_r.length"), into)))
    end = F.col("_r.is_last") & (F.col("at_us") >= F.round((F.col("_r.before_us") + F.col("_r.length")) / F.col("_r.speed")))
    return met.withColumn("_at", (F.col("_r.before_us") + F.when(end, F.col("_r.length")).otherwise(inside)).cast("long")).drop("_r", "_kind", "at")


def _pieces(offsets: DataFrame, placed: DataFrame) -> DataFrame:
    """Ranges cut at the cards inside them, on the line of the retained time."""
    line = offsets.select("entity", F.col("before_us").alias("start_us"), (F.col("before_us") + F.col("end_us") - F.col("start_us")).alias("end_us"), (F.col("start_us") - F.col("before_us")).alias("_shift"))
    cuts = placed.select("entity", F.col("_at").alias("at_us")).distinct()
    cut = intervals.segments(line.select("entity", "start_us", "end_us"), cuts).withColumnsRenamed({"start_us": "at", "end_us": "_e"})
    marks = line.select("entity", F.col("start_us").alias("at"), "_shift", F.lit(0).alias("_k")).unionByName(cut.withColumn("_k", F.lit(1)), allowMissingColumns=True)
    shift = F.last("_shift", ignorenulls=True).over(Window.partitionBy("entity").orderBy("at", "_k").rowsBetween(Window.unboundedPreceding, 0))
    own = marks.withColumn("_shift", shift).filter("_k = 1")
    none = F.lit(None).cast("long")
    return own.select("entity", "at", F.lit(1).alias("_kind"), none.alias("at_us"), none.alias("ordinal"), F.lit(None).cast("string").alias("type"), (F.col("_e") - F.col("at")).alias("_length"), (F.col("at") + F.col("_shift")).alias("start_us"), (F.col("_e") + F.col("_shift")).alias("end_us"))
