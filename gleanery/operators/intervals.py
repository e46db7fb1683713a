"""Time ranges in microseconds: islands, gaps, time mapping, overlaps, keyframes. One row a range (entity, start_us, end_us)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most ranges and keyframes of an entity.
MOST_RANGES, MOST_KEYFRAMES = 32, 256


def islands(ranges: DataFrame, duration: Column | None = None) -> DataFrame:
    """Ranges clamped to [0, duration], empty ones dropped, touching and overlapping ones merged."""
    start, end = F.greatest(F.lit(0), F.round("start_us").cast("long")), F.round("end_us").cast("long")
    end = end if duration is None else F.least(end, duration)
    clean = ranges.select("entity", start.alias("start_us"), end.alias("end_us")).filter("end_us > start_us")
    order = Window.partitionBy("entity").orderBy("start_us", "end_us")
    reach = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = clean.withColumn("_new", F.coalesce((F.col("start_us") > reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("entity", "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_island")


def checked(normal: DataFrame, most: int = MOST_RANGES) -> DataFrame:
    """Raises when an entity has more than ``most`` ranges."""
    n = F.count("*").over(Window.partitionBy("entity"))
    return normal.withColumn("_n", n).filter(F.when(F.col("_n") > most, F.raise_error(F.lit("too many ranges"))).otherwise(F.lit(True))).drop("_n")


def gaps(normal: DataFrame, durations: DataFrame) -> DataFrame:
    """What merged ranges leave of [0, duration_us]; ``durations``: entity, duration_us. An entity without ranges is one gap."""
    order = Window.partitionBy("entity").orderBy("start_us")
    inner = normal.select("entity", F.coalesce(F.lag("end_us").over(order), F.lit(0)).alias("g0"), F.col("start_us").alias("g1"))
    last = durations.join(normal.groupBy("entity").agg(F.max("end_us").alias("_e")), "entity", "left").select("entity", F.coalesce("_e", F.lit(0)).alias("g0"), F.col("duration_us").alias("g1"))
    return inner.unionByName(last).filter("g1 > g0").select("entity", F.col("g0").alias("start_us"), F.col("g1").alias("end_us"))


def output_duration(normal: DataFrame, speed: float = 1.0) -> DataFrame:
    return normal.groupBy("entity").agg(F.round(F.sum(F.col("end_us") - F.col("start_us")) / speed).cast("long").alias("output_us"))


def with_offsets(normal: DataFrame) -> DataFrame:
    """Ranges with the retained time before them and whether they are the entity's last."""
    order = Window.partitionBy("entity").orderBy("start_us")
    before = F.coalesce(F.sum(F.col("end_us") - F.col("start_us")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return normal.withColumn("before_us", before).withColumn("is_last", F.lead("start_us").over(order).isNull())


def source_to_output(points: DataFrame, normal: DataFrame, speed: float = 1.0) -> DataFrame:
    """points (entity, time_us) with output_us: null in gaps. Ranges are half-open, an entity's last one is closed.

    An as-of lookup: points and ranges share one sorted window per entity, so no point meets every range.
    """
    r = with_offsets(normal).select("entity", F.col("start_us").alias("at"), F.struct("start_us", "end_us", "before_us", "is_last").alias("_r"), F.lit(None).cast("long").alias("time_us"), F.lit(0).alias("_kind"))
    p = points.select("entity", F.col("time_us").alias("at"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), "time_us", F.lit(1).alias("_kind"))
    order = Window.partitionBy("entity").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = r.unionByName(p).withColumn("_r", F.last("_r", ignorenulls=True).over(order)).filter("_kind = 1")
    inside = (F.col("time_us") < F.col("_r.end_us")) | (F.col("_r.is_last") & (F.col("time_us") == F.col("_r.end_us")))
    return met.select("entity", "time_us", F.when(inside, F.round((F.col("_r.before_us") + F.col("time_us") - F.col("_r.start_us")) / speed).cast("long")).alias("output_us"))


def output_to_source(points: DataFrame, normal: DataFrame, speed: float = 1.0) -> DataFrame:
    """points (entity, output_us) with time_us; a seam belongs to the next range, past the end is null."""
    r = with_offsets(normal).select("entity", F.col("before_us").alias("at"), F.struct("start_us", "end_us", "before_us", "is_last").alias("_r"), F.lit(None).cast("long").alias("output_us"), F.lit(0).alias("_kind"))
    p = points.select("entity", F.round(F.col("output_us") * speed).cast("long").alias("at"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), "output_us", F.lit(1).alias("_kind"))
    order = Window.partitionBy("entity").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = r.unionByName(p).withColumn("_r", F.last("_r", ignorenulls=True).over(order)).filter("_kind = 1")
    time = F.col("_r.start_us") + F.col("at") - F.col("_r.before_us")
    inside = (time < F.col("_r.end_us")) | (F.col("_r.is_last") & (time == F.col("_r.end_us")))
    return met.select("entity", "output_us", F.when(inside, time).alias("time_us"))


def active_at(time: Column, start: Column, end: Column) -> Column:
    """True in a closed interval, and always where there is none."""
    return start.isNull() | time.between(start, end)


def overlap_hull(layers: DataFrame, normal: DataFrame, bucket_us: int = 60_000_000) -> DataFrame:
    """layer, start_us, end_us: the hull of what a layer's active range shares with the retained ranges; layers that share nothing go.

    Both sides are dealt into time buckets and meet there, so an entity with many ranges isn't one cross product.
    """
    lo, hi = lambda c: F.floor(F.col(c) / bucket_us), lambda c: F.floor((F.col(c) - 1) / bucket_us)
    left = layers.select("entity", "layer", F.col("start_us").alias("_a"), F.col("end_us").alias("_b"), F.explode(F.sequence(lo("start_us"), F.greatest(lo("start_us"), hi("end_us")))).alias("_k"))
    right = normal.select("entity", "start_us", "end_us", F.explode(F.sequence(lo("start_us"), F.greatest(lo("start_us"), hi("end_us")))).alias("_k"))
    met = left.join(right, ["entity", "_k"]).filter(F.greatest("_a", "start_us") < F.least("_b", "end_us"))
    return met.groupBy("entity", "layer").agg(F.min(F.greatest("_a", "start_us")).alias("start_us"), F.max(F.least("_b", "end_us")).alias("end_us"))


def normal_keyframes(keyframes: DataFrame, low: int, high: int) -> DataFrame:
    """Times rounded and clamped; of one time the last (by ordinal) stays."""
    timed = keyframes.withColumn("time_us", F.greatest(F.lit(low), F.least(F.lit(high), F.round("time_us").cast("long"))))
    last = F.row_number().over(Window.partitionBy("entity", "time_us").orderBy(F.desc("ordinal")))
    return timed.withColumn("_r", last).filter("_r = 1").drop("_r")


def interpolate(points: DataFrame, keyframes: DataFrame, value: str = "value", hold: bool = False) -> DataFrame:
    """points (entity, time_us) with the keyframes' value there: the nearest outside their span, between two linear (or the earlier one's)."""
    k = keyframes.select("entity", "time_us", F.struct("time_us", F.col(value).cast("double").alias("v")).alias("_k"), F.lit(0).alias("_kind"))
    p = points.select("entity", "time_us", F.lit(None).cast(k.schema["_k"].dataType).alias("_k"), F.lit(1).alias("_kind"))
    back = Window.partitionBy("entity").orderBy("time_us", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("entity").orderBy(F.desc("time_us"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    met = k.unionByName(p).withColumn("_a", F.last("_k", ignorenulls=True).over(back)).withColumn("_b", F.last("_k", ignorenulls=True).over(ahead)).filter("_kind = 1")
    t0, t1, v0, v1 = F.col("_a.time_us"), F.col("_b.time_us"), F.col("_a.v"), F.col("_b.v")
    between = v0 if hold else v0 + (v1 - v0) * (F.col("time_us") - t0) / (t1 - t0)
    return met.select("entity", "time_us", F.when(t0.isNull(), v1).when(t1.isNull() | (t0 == F.col("time_us")), v0).otherwise(between).alias("value"))


def segments(normal: DataFrame, splits: DataFrame) -> DataFrame:
    """Ranges cut at split points (entity, at_us) strictly inside them."""
    cut = normal.join(splits, "entity").filter((F.col("at_us") > F.col("start_us")) & (F.col("at_us") < F.col("end_us")))
    edges = normal.select("entity", "start_us", "end_us", F.col("start_us").alias("_at")).unionByName(cut.select("entity", "start_us", "end_us", F.col("at_us").alias("_at"))).distinct()
    after = F.lead("_at").over(Window.partitionBy("entity", "start_us").orderBy("_at"))
    return edges.select("entity", F.col("_at").alias("start_us"), F.coalesce(after, F.col("end_us")).alias("end_us"))


def nearest_boundary(points: DataFrame, normal: DataFrame) -> DataFrame:
    """points with the retained time nearest to them: themselves inside a range, else the nearer edge (of equals the earlier)."""
    edges = normal.select("entity", F.struct("start_us", "end_us").alias("_r"))
    met = points.join(edges, "entity").withColumn("_t", F.greatest("_r.start_us", F.least("_r.end_us", "time_us")))
    return met.groupBy("entity", "time_us").agg(F.min_by("_t", F.struct(F.abs(F.col("_t") - F.col("time_us")), "_t")).alias("nearest_us"))


def frame_ladder(n: int, horizon_ms: int = 18_000, start_ms: int = 300) -> list[int]:
    """``n`` times from start to horizon with equal ratios."""
    return [] if n <= 0 else [start_ms] if n == 1 else [round(start_ms * (horizon_ms / start_ms) ** (i / (n - 1))) for i in range(n)]


def snap(time: Column, interval_us: int, duration_us: int) -> Column:
    """The nearest frame time within [0, duration]."""
    return F.least(F.lit(duration_us), F.greatest(F.lit(0), F.round(time / interval_us) * interval_us)).cast("long")


def trimmed(normal: DataFrame, edits: DataFrame, durations: DataFrame, least: int) -> DataFrame:
    """entity, start_us, end_us, edge, clamped_us: where a dragged edge of a range may go (edits: entity, start_us of the range, edge ``start`` or ``end``, proposed_us).

    An edge stays ``least`` from the other one, doesn't pass the neighbouring range, and keeps to [0, duration_us]; without a proposal it stays.
    """
    order = Window.partitionBy("entity").orderBy("start_us")
    around = normal.withColumns({"_before": F.coalesce(F.lag("end_us").over(order), F.lit(0)), "_after": F.lead("start_us").over(order)})
    met = around.join(edits, ["entity", "start_us"]).join(durations, "entity")
    first = F.col("edge") == "start"
    low = F.when(first, F.col("_before")).otherwise(F.col("start_us") + least)
    high = F.when(first, F.col("end_us") - least).otherwise(F.coalesce("_after", "duration_us"))
    inside = lambda x, a, b: F.greatest(a, F.least(x, b))
    low = inside(low, F.lit(0), F.col("duration_us"))
    high = inside(high, low, F.col("duration_us"))
    wanted = F.coalesce("proposed_us", F.when(first, F.col("start_us")).otherwise(F.col("end_us")))
    return met.select("entity", "start_us", "end_us", "edge", F.round(inside(wanted, low, high)).cast("long").alias("clamped_us"))


def kept_splits(splits: DataFrame, normal: DataFrame) -> DataFrame:
    """Split points (entity, at_us, rounded, each once) strictly inside a range."""
    points = splits.select("entity", F.round("at_us").cast("long").alias("at_us")).distinct().alias("p")
    inside = (F.col("p.entity") == F.col("r.entity")) & (F.col("at_us") > F.col("start_us")) & (F.col("at_us") < F.col("end_us"))
    return points.join(normal.alias("r"), inside, "left_semi")


def inserted_splits(asked: DataFrame, splits: DataFrame, normal: DataFrame, least: int) -> DataFrame:
    """entity, at_us, accepted: whether a new split point (each on its own) is strictly inside a range, isn't there yet and leaves ``least`` to its neighbours and the range's ends.

    Points, edges and questions are one ordered stream an entity; no question is paired with all points.
    """
    at = F.round("at_us").cast("long")
    marks = kept_splits(splits, normal).select("entity", "at_us", F.lit("split").alias("_k"))
    edges = normal.select("entity", F.explode(F.array(F.struct(F.col("start_us").alias("at_us"), F.lit("open").alias("_k")), F.struct(F.col("end_us").alias("at_us"), F.lit("close").alias("_k")))).alias("_e")).select("entity", "_e.*")
    stream = marks.union(edges).unionByName(asked.select("entity", at.alias("at_us"), F.lit("ask").alias("_k")).distinct())
    mark = F.when(F.col("_k") != "ask", F.struct("at_us", "_k"))
    order = Window.partitionBy("entity").orderBy("at_us", F.when(F.col("_k") == "ask", 1).otherwise(0))
    back = Window.partitionBy("entity").orderBy(F.desc("at_us"), F.when(F.col("_k") == "ask", 1).otherwise(0))
    frame = (Window.unboundedPreceding, 0)
    met = stream.withColumns({"_l": F.last(mark, True).over(order.rowsBetween(*frame)), "_h": F.last(mark, True).over(back.rowsBetween(*frame))}).filter("_k = 'ask'")
    inside = F.col("_l._k").isin("open", "split") & F.col("_h._k").isin("close", "split")
    apart = (F.col("at_us") - F.col("_l.at_us") >= F.greatest(F.lit(1), F.lit(least))) & (F.col("_h.at_us") - F.col("at_us") >= F.greatest(F.lit(1), F.lit(least)))
    return met.select("entity", "at_us", F.coalesce(inside & apart, F.lit(False)).alias("accepted"))


def without_segment(normal: DataFrame, splits: DataFrame, gone: DataFrame) -> DataFrame:
    """Ranges without the segment that begins at ``start_us`` (gone: entity, start_us); an entity that would have nothing left keeps all."""
    cut = segments(normal, kept_splits(splits, normal))
    left = cut.join(gone.select("entity", "start_us"), ["entity", "start_us"], "left_anti")
    n = lambda df, name: df.groupBy("entity").agg(F.count("*").alias(name))
    empty = n(cut, "_a").join(n(left, "_b"), "entity", "left_anti").select("entity")
    return islands(left.select("entity", "start_us", "end_us").unionByName(normal.join(empty, "entity").select("entity", "start_us", "end_us")))


def tick_interval(duration_us: Column, content_px: Column, tile_px: float, most: int, base_us: int) -> Column:
    """The least ``base_us`` times a power of two at which a tile is ``tile_px`` wide and there are at most ``most`` of them."""
    need = F.greatest(F.when(content_px > 0, tile_px * duration_us / content_px).otherwise(duration_us), duration_us / most)
    return F.when(duration_us > 0, base_us * F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(need / base_us)).cast("double")))).otherwise(base_us).cast("long")


def keyframes_around(points: DataFrame, keyframes: DataFrame) -> DataFrame:
    """entity, time_us of each point once, with exact (a keyframe is at it), previous_us and next_us (the keyframes strictly before and after it, null if none).

    Points and keyframes are one ordered stream an entity.
    """
    marks = keyframes.select("entity", "time_us", F.lit(True).alias("_mark")).distinct()
    stream = marks.unionByName(points.select("entity", "time_us", F.lit(False).alias("_mark")).distinct())
    at = F.when(F.col("_mark"), F.col("time_us"))
    frame = (Window.unboundedPreceding, -1)
    # A point stands before a keyframe of its time in either direction, so that one isn't seen.
    before = Window.partitionBy("entity").orderBy("time_us", "_mark").rowsBetween(*frame)
    after = Window.partitionBy("entity").orderBy(F.desc("time_us"), "_mark").rowsBetween(*frame)
    here = F.max("_mark").over(Window.partitionBy("entity", "time_us"))
    return stream.withColumns({"exact": here, "previous_us": F.last(at, True).over(before), "next_us": F.last(at, True).over(after)}).filter("not _mark").drop("_mark")


def frame_steps(times: DataFrame, frame_us: int) -> DataFrame:
    """entity, time_us, with frame (the number of the nearest frame of a grid of ``frame_us``, halves up) and snapped_us, its time."""
    n = F.floor(F.col("time_us") / frame_us + 0.5).cast("long")
    return times.select("entity", "time_us", F.greatest(F.lit(0).cast("long"), n).alias("frame"), (F.greatest(F.lit(0).cast("long"), n) * frame_us).alias("snapped_us"))
