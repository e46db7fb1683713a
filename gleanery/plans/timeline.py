"""Ranges, keyframes, sessions over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import composing, intervals
from gleanery.plans.register import query
from gleanery.sources.tables import table
from gleanery.streaming import events as streams

START = 1_704_067_200_000_000  # 2024-01-01 in microseconds
MONTH = 30 * 86_400_000_000
RANGES = f"r AS (SELECT user_id AS entity, epoch_us(ts) - {START} AS start_us, epoch_us(ts) - {START} + (round(value * 100)::BIGINT) * 500000 AS end_us FROM events)"
ISLANDS = f"""{RANGES}, c AS (SELECT entity, greatest(0, start_us) AS start_us, least(end_us, {MONTH}) AS end_us FROM r WHERE least(end_us, {MONTH}) > greatest(0, start_us)),
k AS (SELECT *, CASE WHEN start_us > max(end_us) OVER w THEN 1 WHEN max(end_us) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM c WINDOW w AS (PARTITION BY entity ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(n) OVER (PARTITION BY entity ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS i FROM k), islands AS (SELECT entity, min(start_us) AS start_us, max(end_us) AS end_us FROM g GROUP BY entity, i)"""
OFFSETS = f"""{ISLANDS}, o AS (SELECT *, coalesce(sum(end_us - start_us) OVER (PARTITION BY entity ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_us, lead(start_us) OVER (PARTITION BY entity ORDER BY start_us) IS NULL AS is_last FROM islands)"""


def _us(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp")) - F.lit(START)


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("entity"), _us().alias("start_us"), (_us() + F.round(F.col("value") * 100).cast("long") * 500_000).alias("end_us"))


def _islands(spark: SparkSession, d: str) -> DataFrame:
    return intervals.islands(_ranges(spark, d), F.lit(MONTH))


@query(f"WITH {ISLANDS} SELECT entity, start_us, end_us FROM islands")
def range_islands(spark: SparkSession, d: str) -> DataFrame:
    return _islands(spark, d)


@query(f"""WITH {ISLANDS}, x AS (SELECT entity, coalesce(lag(end_us) OVER (PARTITION BY entity ORDER BY start_us), 0) AS a, start_us AS b FROM islands UNION ALL SELECT u.entity, coalesce(max(i.end_us), 0), {MONTH} FROM (SELECT DISTINCT user_id AS entity FROM events) u LEFT JOIN islands i USING (entity) GROUP BY u.entity)
SELECT entity, a AS start_us, b AS end_us FROM x WHERE b > a""")
def range_gaps(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select(F.col("user_id").alias("entity")).distinct().withColumn("duration_us", F.lit(MONTH))
    return intervals.gaps(_islands(spark, d), users)


@query(f"WITH {ISLANDS} SELECT entity, round(sum(end_us - start_us) / 1.5)::BIGINT AS output_us FROM islands GROUP BY entity")
def output_duration(spark: SparkSession, d: str) -> DataFrame:
    return intervals.output_duration(_islands(spark, d), 1.5)


@query(f"""WITH {OFFSETS}, p AS (SELECT DISTINCT user_id AS entity, epoch_us(ts) - {START} + 3600000000 AS time_us FROM events)
SELECT p.entity, p.time_us, CASE WHEN p.time_us < o.end_us OR (o.is_last AND p.time_us = o.end_us) THEN round((o.before_us + p.time_us - o.start_us) / 2.0)::BIGINT END AS output_us FROM p ASOF LEFT JOIN o ON p.entity = o.entity AND p.time_us >= o.start_us""")
def time_map(spark: SparkSession, d: str) -> DataFrame:
    """An hour after each event, in retained time at double speed."""
    points = table(spark, d, "events").select(F.col("user_id").alias("entity"), (_us() + 3_600_000_000).alias("time_us")).distinct()
    return intervals.source_to_output(points, _islands(spark, d), 2.0)


@query(f"""WITH {OFFSETS}, p AS (SELECT DISTINCT user_id AS entity, ((epoch_us(ts) - {START}) // 4)::BIGINT AS output_us FROM events), m AS (SELECT p.entity, p.output_us, o.start_us + p.output_us - o.before_us AS t, o.end_us, o.is_last FROM p ASOF LEFT JOIN o ON p.entity = o.entity AND p.output_us >= o.before_us)
SELECT entity, output_us, CASE WHEN t < end_us OR (is_last AND t = end_us) THEN t END AS time_us FROM m""")
def time_unmap(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.floor(_us() / 4).alias("output_us")).distinct()
    return intervals.output_to_source(points, _islands(spark, d))


@query(f"""WITH {ISLANDS}, l AS (SELECT user_id AS entity, event_id AS layer, epoch_us(ts) - {START} AS a, epoch_us(ts) - {START} + 7200000000 AS b FROM events WHERE event_type = 'view')
SELECT l.entity, layer, min(greatest(a, start_us)) AS start_us, max(least(b, end_us)) AS end_us FROM l JOIN islands i ON l.entity = i.entity AND greatest(a, start_us) < least(b, end_us) GROUP BY ALL""")
def layer_overlap(spark: SparkSession, d: str) -> DataFrame:
    views = table(spark, d, "events").filter("event_type = 'view'")
    layers = views.select(F.col("user_id").alias("entity"), F.col("event_id").alias("layer"), _us().alias("start_us"), (_us() + 7_200_000_000).alias("end_us"))
    return intervals.overlap_hull(layers, _islands(spark, d), 3_600_000_000)


@query(f"""WITH k AS (SELECT user_id AS entity, epoch_us(ts) - {START} AS t, max_by(value, event_id) AS v FROM events WHERE event_type = 'click' GROUP BY ALL), p AS (SELECT DISTINCT user_id AS entity, epoch_us(ts) - {START} AS time_us FROM events WHERE event_type = 'view'),
a AS (SELECT p.entity, p.time_us, k.t AS t0, k.v AS v0 FROM p ASOF LEFT JOIN k ON p.entity = k.entity AND p.time_us >= k.t), b AS (SELECT a.*, k.t AS t1, k.v AS v1 FROM a ASOF LEFT JOIN k ON a.entity = k.entity AND a.time_us <= k.t)
SELECT entity, time_us, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = time_us THEN v0 ELSE v0 + (v1 - v0) * (time_us - t0) / (t1 - t0) END, 6) AS value FROM b""")
def asof_lerp(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as keyframes, views as points."""
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"), _us().alias("time_us"), "value", F.col("event_id").alias("ordinal"), "event_type")
    keys = intervals.normal_keyframes(e.filter("event_type = 'click'"), 0, MONTH)
    return intervals.interpolate(e.filter("event_type = 'view'").select("entity", "time_us").distinct(), keys).withColumn("value", F.round("value", 6))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM e)
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS events FROM g GROUP BY user_id, i""")
def session_debounce(spark: SparkSession, d: str) -> DataFrame:
    found = streams.debounce(table(spark, d, "events"), "30 minutes", ["user_id"])
    return found.select("user_id", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended"), "events")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_totals(spark: SparkSession, d: str) -> DataFrame:
    found = streams.tumbling(table(spark, d, "events"), "1 day", ["event_type"])
    return found.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, props FROM events)")
def dedupe_events(spark: SparkSession, d: str) -> DataFrame:
    return streams.once(table(spark, d, "events"), ["user_id", "props"]).agg(F.count("*").alias("n"))


RECTS = f"""k AS (SELECT user_id AS entity, epoch_us(ts) - {START} AS t, max_by({{'x': (event_id % 10) / 9, 'y': (event_id % 7) / 8, 'w': value / 150, 'h': 0.5::DOUBLE, 'hold': event_id % 3 = 0, 'm': 'm' || (event_id % 2)}}, event_id) AS v FROM events WHERE event_type = 'click' GROUP BY ALL),
p AS (SELECT DISTINCT user_id AS entity, epoch_us(ts) - {START} AS time_us FROM events WHERE event_type IN ('view', 'click')), s AS (SELECT user_id AS entity, epoch_us(ts) - {START} AS a, epoch_us(ts) - {START} + 86400000000 AS b FROM events WHERE event_type = 'signup')"""


@query(f"""WITH {RECTS}, l AS (SELECT p.entity, p.time_us, k.t AS t0, k.v AS a FROM p ASOF LEFT JOIN k ON p.entity = k.entity AND p.time_us >= k.t), n AS (SELECT l.*, k.t AS t1, k.v AS b FROM l ASOF LEFT JOIN k ON l.entity = k.entity AND l.time_us < k.t),
i AS (SELECT entity, time_us, coalesce(a.m, b.m) AS mode, CASE WHEN a IS NULL THEN [b.x, b.y, b.w, b.h] WHEN b IS NULL OR a.hold THEN [a.x, a.y, a.w, a.h] ELSE [a.x + (b.x - a.x) * (time_us - t0) / (t1 - t0), a.y + (b.y - a.y) * (time_us - t0) / (t1 - t0), a.w + (b.w - a.w) * (time_us - t0) / (t1 - t0), 0.5] END AS r,
  EXISTS (SELECT 1 FROM s WHERE s.entity = n.entity AND time_us BETWEEN s.a AND s.b) OR NOT EXISTS (SELECT 1 FROM s WHERE s.entity = n.entity) AS shown FROM n)
SELECT entity, time_us, CASE WHEN shown THEN round(r[1], 6) END AS x, CASE WHEN shown THEN round(r[2], 6) END AS y, CASE WHEN shown THEN round(least(r[3], 1 - r[1]), 6) END AS width, CASE WHEN shown THEN round(least(r[4], 1 - r[2]), 6) END AS height, CASE WHEN shown THEN mode END AS mode FROM i""")
def rect_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as corrections of a user's rectangle, clicks and views as points, the day after each sign-up as the time in which it is shown."""
    i = F.col("event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"), _us().alias("time_us"), "value", i.alias("ordinal"), "event_type", ((i % 10) / 9).alias("x"), ((i % 7) / 8).alias("y"), (F.col("value") / 150).alias("width"), F.lit(0.5).alias("height"), F.when(i % 3 == 0, "hold").otherwise("linear").alias("easing"), F.concat(F.lit("m"), (i % 2).cast("string")).alias("mode"))
    active = e.filter("event_type = 'signup'").select("entity", F.col("time_us").alias("start_us"), (F.col("time_us") + 86_400_000_000).alias("end_us"))
    found = composing.rects(e.filter("event_type in ('view', 'click')").select("entity", "time_us").distinct(), e.filter("event_type = 'click'"), active)
    return found.select("entity", "time_us", *[F.round(c, 6).alias(c) for c in composing.SIDES], "mode")


@query(None)
def composition_segments(spark: SparkSession, d: str) -> DataFrame:
    """Clicks of a user as ranges of some minutes, every fifth sign-up as a card, users in turn at four speeds; tests hold this against brute force."""
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"), _us().alias("time_us"), "value", F.col("event_id").alias("ordinal"), "event_type")
    projects = e.select("entity").distinct().select("entity", F.lit(MONTH).alias("duration_us"), F.get(F.array(*[F.lit(s) for s in (0.5, 1.0, 1.5, 2.0)]), (F.col("entity") % 4).cast("int")).alias("speed"))
    ranges = e.filter("event_type = 'click'").select("entity", F.col("time_us").alias("start_us"), (F.col("time_us") + F.col("value").cast("long") * 60_000_000).alias("end_us"))
    cards = e.filter("event_type = 'signup' and ordinal % 5 = 0").select("entity", "ordinal", F.lit("cards/one.png").alias("uri"), ((F.col("value") + 1).cast("long") * 100_000 + 200_000).alias("duration_us"), F.floor(F.col("time_us") / 10_000).alias("at_us"))
    segments, _ = composing.compositions(projects, ranges, cards, 10_000)
    return segments
