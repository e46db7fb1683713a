"""State changes, exemplars, simple reads and edits of ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators import evaluate, facets, intervals, reads, states
from gleanery.plans import bindings as B
from gleanery.plans import tagging, timeline
from gleanery.plans.register import query
from gleanery.sources.tables import table


def _items(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        i.alias("id"), F.when(i % 2 == 0, "video").otherwise("image").alias("kind"), F.col("source").alias("caption"), F.lit("failed").alias("vision_state"), F.lit("old").alias("transcript"), F.when(i % 3 == 0, "failed").otherwise("done").alias("audio_state"), (i % 5 == 0).alias("pending"),
    )


ITEMS = "items AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'video' ELSE 'image' END AS kind, source AS caption, 'failed' AS vision_state, 'old' AS transcript, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'done' END AS audio_state, doc_id % 5 = 0 AS pending FROM documents)"


@query(f"""WITH {ITEMS} SELECT id, CASE WHEN toxic = 1 THEN '' WHEN l.doc_id IS NOT NULL THEN 'quality ' || quality ELSE caption END AS caption, CASE WHEN toxic = 1 THEN 'pending' WHEN l.doc_id IS NOT NULL THEN 'done' ELSE 'failed' END AS vision_state
FROM items LEFT JOIN labels l ON id = l.doc_id""")
def vision_states(spark: SparkSession, d: str) -> DataFrame:
    """Labels as descriptions; toxic ones wait again."""
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    told = states.set_vision(_items(spark, d), labels.select("id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("caption")))
    return states.requeue_vision(told, labels.filter("toxic = 1")).select("id", "caption", "vision_state")


@query(f"""WITH {ITEMS}, last AS (SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1)
SELECT id, CASE WHEN l.conv_id IS NOT NULL AND NOT (kind = 'video' AND id % 7 = 0) THEN l.text WHEN kind = 'video' AND id % 7 = 0 THEN '' ELSE transcript END AS transcript,
CASE WHEN kind = 'video' AND id % 7 = 0 THEN 'pending' WHEN l.conv_id IS NOT NULL THEN 'done' ELSE audio_state END AS audio_state FROM items LEFT JOIN last l ON id = l.conv_id""")
def transcript_states(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's last turn as transcript; videos with every seventh id wait again."""
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("transcript"), F.col("turn").alias("at"))
    items = states.set_transcript(_items(spark, d), said)
    return states.requeue_transcript(items, items.filter("id % 7 = 0")).select("id", "transcript", "audio_state")


@query(f"""WITH {ITEMS} SELECT id, CASE WHEN kind = 'video' AND NOT pending THEN '' ELSE transcript END AS transcript, CASE WHEN kind = 'video' AND NOT pending THEN 'pending' ELSE audio_state END AS audio_state FROM items""")
def transcript_reset(spark: SparkSession, d: str) -> DataFrame:
    return states.reset_transcripts(_items(spark, d)).select("id", "transcript", "audio_state")


EXEMPLARS = """e AS (SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN ' L' ELSE 'l' END || label AS label, CASE WHEN vec_id % 5 = 0 THEN '' ELSE 'u' || (vec_id % 150) END AS source_uri, vec_id % 2 = 0 AS positive, CASE WHEN vec_id % 3 = 0 THEN 'old' ELSE 'new' END AS model, embedding[1]::DOUBLE AS v FROM embeddings),
i AS (SELECT 'u' || doc_id AS source_uri, n_chars::DOUBLE AS nv FROM documents WHERE lang <> 'en' AND n_chars > 0)"""


def _exemplars(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        i.alias("id"), F.concat(F.when(i % 4 == 0, " L").otherwise("l"), F.col("label").cast("string")).alias("label"), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("u"), (i % 150).cast("string"))).alias("source_uri"), (i % 2 == 0).alias("positive"), F.when(i % 3 == 0, "old").otherwise("new").alias("model"),
        F.array(F.get("embedding", F.lit(0)).cast("double")).alias("vector"),
    )


@query(f"""WITH {EXEMPLARS}, m AS (SELECT e.*, nv, lower(trim(label)) AS name FROM e LEFT JOIN i USING (source_uri)), moves AS (SELECT *, row_number() OVER (PARTITION BY name, source_uri, positive ORDER BY id) AS r FROM m WHERE model <> 'new' AND source_uri <> '' AND nv IS NOT NULL),
fresh AS (SELECT id, name AS label, 'new' AS model, nv AS v FROM moves WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM e k WHERE k.model = 'new' AND k.label = moves.name AND k.source_uri = moves.source_uri AND k.positive = moves.positive))
SELECT id, label, model, v FROM m WHERE NOT (model <> 'new' AND source_uri <> '' AND nv IS NOT NULL) UNION ALL SELECT id, label, model, v FROM fresh""")
def exemplar_migration(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    items = docs.select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("uri"), F.when(F.col("n_chars") > 0, F.array(F.col("n_chars").cast("double"))).otherwise(F.array().cast("array<double>")).alias("embedding"), (F.col("lang") == "en").alias("pending"))
    return states.migrate_exemplars(_exemplars(spark, d), items, "new")[0].select("id", "label", "model", F.get("vector", F.lit(0)).alias("v"))


@query("""WITH known AS (SELECT 'l' || label AS label, 'a' AS model, min(vec_id)::DOUBLE AS v FROM embeddings WHERE label < 7 GROUP BY label), more AS (SELECT label, 'a' AS model, v FROM (SELECT 'l' || label AS label, vec_id::DOUBLE AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM embeddings WHERE label > 4) WHERE r = 1)
SELECT * FROM known WHERE label NOT IN (SELECT label FROM more) UNION ALL SELECT * FROM more""")
def label_vector_put(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("label"), F.lit("a").alias("model"), F.array(F.col("vec_id").cast("double")).alias("vector"), F.col("vec_id").alias("at"), F.col("label").alias("n"))
    known = rows.filter("n < 7").groupBy("label", "model").agg(F.min("vector").alias("vector"))
    return states.put_label_vectors(known, rows.filter("n > 4")).select("label", "model", F.get("vector", F.lit(0)).alias("v"))


@query(f"WITH {EXEMPLARS} SELECT DISTINCT label FROM e WHERE model = 'new'")
def taught_list(spark: SparkSession, d: str) -> DataFrame:
    return reads.taught(_exemplars(spark, d), "new")


@query("""SELECT doc_id AS id, concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN source END, CASE WHEN doc_id % 3 = 0 THEN lang END) AS tags FROM documents WHERE doc_id % 5 <> 0""")
def described_labels(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    tag = lambda label, n, other: F.struct(F.col(label).alias("label"), F.when(i % n == 0, "vision").otherwise(other).alias("source"))
    items = table(spark, d, "documents").select(i.alias("id"), F.array(tag("source", 2, "ocr"), tag("lang", 3, "manual")).alias("tags"), F.when(i % 5 == 0, "pending").otherwise("done").alias("vision_state"))
    return reads.described_tags(items).select("id", F.array_join("tags", ",").alias("tags"))


@query("SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
def folder_rows(spark: SparkSession, d: str) -> DataFrame:
    return reads.under_folder(table(spark, d, "part"), "Brand#1", "p_brand").select("p_partkey", "p_brand")


@query("SELECT o_orderkey, o_custkey, o_totalprice, rank FROM (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 40")
def winner_rows(spark: SparkSession, d: str) -> DataFrame:
    """The forty dearest orders, found by two columns and then read whole."""
    orders = table(spark, d, "orders")
    top = orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40)
    ranked = top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("rank"))
    return reads.winners(ranked, orders, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice", "rank")


@query(f"WITH a AS (SELECT {B.Q} AS q) SELECT vec_id FROM embeddings, a WHERE list_cosine_similarity(embedding::DOUBLE[], q) >= 0.25")
def look_alikes(spark: SparkSession, d: str) -> DataFrame:
    return reads.look_alikes(table(spark, d, "embeddings"), B.query_vector(spark, d), 0.25).select("vec_id")


@query("SELECT count(*) AS items, count(DISTINCT source) AS folders, count(*) FILTER (WHERE lang <> 'en') AS tagged, round(count(*) FILTER (WHERE lang <> 'en') / count(*), 6) AS tagged_share FROM documents")
def harvest_report(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").select(F.col("source").alias("folder"), F.array(F.upper("lang")).alias("tags"))
    return reads.harvest_stats(items, ("en",)).withColumn("tagged_share", F.round("tagged_share", 6))


@query("SELECT CASE WHEN source IN ('src0', 'src1') THEN '(none)' ELSE source END AS folder, count(*) AS items FROM documents GROUP BY ALL")
def folder_counts(spark: SparkSession, d: str) -> DataFrame:
    return reads.folder_stats(table(spark, d, "documents").select(F.when(F.col("source").isin("src0", "src1"), " ").otherwise(F.col("source")).alias("folder")))


@query("SELECT user_id, round(sqrt(avg(value * value)), 5) AS rms, round(max(abs(value)), 5) AS peak FROM events GROUP BY user_id")
def waveform_levels(spark: SparkSession, d: str) -> DataFrame:
    bad = F.array(F.col("value"), F.lit(float("nan")), F.lit(float("inf")), F.lit(None).cast("double"))
    samples = table(spark, d, "events").select("user_id", F.explode(bad).alias("value"))
    return reads.waveform_level(samples, "user_id", "value").select("user_id", F.round("rms", 5).alias("rms"), F.round("peak", 5).alias("peak"))


@query("""SELECT doc_id, '"' || source || '" OR "' || lang || '" OR "a ""b"" c"' AS found, source || ',' || lang AS terms FROM documents""")
def match_strings(spark: SparkSession, d: str) -> DataFrame:
    more = F.array(F.col("lang"), F.lit('a "b" c'), F.lit(" "))
    return table(spark, d, "documents").select("doc_id", reads.match_string(F.array(F.upper("source"), F.col("lang")), more).alias("found"), F.array_join(reads.label_terms("source", F.array(F.upper("lang"), F.col("source"), F.lit(""))), ",").alias("terms"))


TRIMS = f"""{timeline.ISLANDS}, n AS (SELECT *, coalesce(lag(end_us) OVER (PARTITION BY entity ORDER BY start_us), 0) AS before, coalesce(lead(start_us) OVER (PARTITION BY entity ORDER BY start_us), {timeline.MONTH}) AS after FROM islands)"""


@query(f"""WITH {TRIMS} SELECT entity, start_us, end_us, 'start' AS edge, greatest(before, least(start_us - 7000000, greatest(before, end_us - 5000000)))::BIGINT AS clamped_us FROM n
UNION ALL SELECT entity, start_us, end_us, 'end', greatest(least(start_us + 5000000, {timeline.MONTH}), least(end_us + 3600000000, greatest(after, least(start_us + 5000000, {timeline.MONTH}))))::BIGINT FROM n""")
def trim_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every range's start is dragged seven seconds back, its end an hour on."""
    ranges = timeline._islands(spark, d)
    edits = ranges.select("entity", "start_us", F.explode(F.array(F.struct(F.lit("start").alias("edge"), (F.col("start_us") - 7_000_000).alias("proposed_us")), F.struct(F.lit("end").alias("edge"), (F.col("end_us") + 3_600_000_000).alias("proposed_us")))).alias("_e")).select("entity", "start_us", "_e.*")
    durations = ranges.select("entity").distinct().withColumn("duration_us", F.lit(timeline.MONTH))
    return intervals.trimmed(ranges, edits, durations, 5_000_000)


POINTS = f"{timeline.ISLANDS}, p AS (SELECT DISTINCT user_id AS entity, epoch_us(ts) - {timeline.START} + 1000000 * (event_id % 40) AS at_us FROM events WHERE event_id % 3 = 0), kept AS (SELECT p.* FROM p WHERE EXISTS (SELECT 1 FROM islands i WHERE i.entity = p.entity AND p.at_us > start_us AND p.at_us < end_us)), a AS (SELECT DISTINCT user_id AS entity, epoch_us(ts) - {timeline.START} + 1000000 * (event_id % 60) AS at_us FROM events)"


@query(f"""WITH {POINTS}, met AS (SELECT a.entity, a.at_us, i.start_us, i.end_us FROM a LEFT JOIN islands i ON i.entity = a.entity AND a.at_us > start_us AND a.at_us < end_us),
n AS (SELECT met.entity, met.at_us, any_value(start_us) AS s, any_value(end_us) AS e, max(k.at_us) FILTER (WHERE k.at_us < met.at_us AND k.at_us > start_us) AS lo, min(k.at_us) FILTER (WHERE k.at_us > met.at_us AND k.at_us < end_us) AS hi, coalesce(bool_or(k.at_us = met.at_us), false) AS there FROM met LEFT JOIN kept k ON k.entity = met.entity GROUP BY met.entity, met.at_us)
SELECT entity, at_us, s IS NOT NULL AND NOT there AND at_us - coalesce(lo, s) >= 5000000 AND coalesce(hi, e) - at_us >= 5000000 AS accepted FROM n""")
def split_inserts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    at = lambda n: e.select(F.col("user_id").alias("entity"), (timeline._us() + 1_000_000 * (F.col("event_id") % n)).alias("at_us"))
    points = e.filter("event_id % 3 = 0").select(F.col("user_id").alias("entity"), (timeline._us() + 1_000_000 * (F.col("event_id") % 40)).alias("at_us"))
    return intervals.inserted_splits(at(60), points, timeline._islands(spark, d), 5_000_000)


@query(f"""WITH {tagging.CENTRES}, a AS (SELECT {B.Q} AS q), s AS (SELECT vec_id AS id, e.label AS truth, m.label, list_cosine_similarity(embedding::DOUBLE[], v) AS c, list_cosine_similarity(embedding::DOUBLE[], q) AS anchor FROM embeddings e, m, a),
t AS (SELECT id, any_value(truth) AS truth, arg_min(label, (-c, label)) AS top, max(c) AS c1, list(c ORDER BY c DESC)[2] AS c2, any_value(anchor) AS anchor, list(c) AS cs FROM s GROUP BY id),
f AS (SELECT *, truth = top AS ok, greatest(c1, anchor) AS most FROM t), x AS (SELECT *, exp(50 * (c1 - most)) / (list_sum(list_transform(cs, lambda c: exp(50 * (c - most)))) + exp(50 * (anchor - most))) AS soft FROM f),
g AS (SELECT 'biased' AS signal, ok, c1 - 0.5 * anchor AS v FROM x UNION ALL SELECT 'cosine', ok, c1 FROM x UNION ALL SELECT 'anchored', ok, c1 - anchor FROM x UNION ALL SELECT 'softmax', ok, soft FROM x UNION ALL SELECT 'gap', ok, c1 - c2 FROM x),
k AS (SELECT signal, ok, rank() OVER (PARTITION BY signal ORDER BY round(v, 9)) + (count(*) OVER (PARTITION BY signal, round(v, 9)) - 1) / 2 AS rk FROM g)
SELECT signal, round((sum(rk) FILTER (WHERE ok) - count(*) FILTER (WHERE ok) * (count(*) FILTER (WHERE ok) + 1) / 2) / (count(*) FILTER (WHERE ok) * count(*) FILTER (WHERE NOT ok)), 6) AS auc FROM k GROUP BY signal""")
def five_signals(spark: SparkSession, d: str) -> DataFrame:
    """Label centroids as vocabulary, the query vector as anchor: how well each signal tells right top labels from wrong ones."""
    v = tagging._vectors(spark, d)
    found = evaluate.signals(v.select("id", "embedding"), tagging._vocabulary(spark, d), [B.query_vector(spark, d)])
    judged = found.join(v.select("id", F.col("label").alias("_t")), "id").select("signal", F.round("score", 9).alias("score"), (F.col("label") == F.col("_t")).alias("correct"))
    return evaluate.auc(judged, ["signal"]).select("signal", F.round("auc", 6).alias("auc"))


FACET_WORDS = (("blue", "action"), ("large", "tone"), ("bolt", "object"), ("bolt", "setting"), ("cold", "emotion"), ("cold", "character"))
FACET_PHRASES = (("small widget", "format"), ("rod", "topic"))
FACETS = "fw(word, facet) AS (VALUES " + ", ".join(f"('{w}', '{f}')" for w, f in FACET_WORDS) + "), fp(phrase, facet) AS (VALUES " + ", ".join(f"('{w}', '{f}')" for w, f in FACET_PHRASES) + "), "
FACETS += "h AS (SELECT DISTINCT p_name AS label, facet FROM part JOIN fw ON list_contains(string_split_regex(lower(p_name), '[^a-z0-9]+'), word) UNION SELECT DISTINCT p_name, facet FROM part JOIN fp ON contains(lower(p_name), phrase))"


def _vocabulary(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(list(FACET_WORDS), "word string, facet string"), spark.createDataFrame(list(FACET_PHRASES), "phrase string, facet string")


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("label"))


@query(f"WITH {FACETS} SELECT label, facet FROM h")
def label_facets(spark: SparkSession, d: str) -> DataFrame:
    return facets.tag_facets(_names(spark, d), *_vocabulary(spark))


@query(f"""WITH {FACETS}, o AS (SELECT label, arg_min(facet, list_position({list(facets.PRIORITY)}, facet)) AS facet FROM h GROUP BY label)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'topic' ELSE coalesce(o.facet, 'character') END AS category FROM part LEFT JOIN o ON label = p_name""")
def refaceted_exemplars(spark: SparkSession, d: str) -> DataFrame:
    rows = _names(spark, d).withColumn("category", F.when(F.col("p_partkey") % 2 == 0, "topic").otherwise("character"))
    return facets.refaceted(rows, *_vocabulary(spark)).select("p_partkey", "category")


@query(f"""WITH {FACETS}, t AS (SELECT p_brand AS id, p_name AS label FROM part), n AS (SELECT count(DISTINCT id) AS n, count(*) AS tags FROM t), c AS (SELECT count(*) AS covered FROM (SELECT DISTINCT id, facet FROM t JOIN h USING (label)))
SELECT n, round(covered / n, 6) AS avg_facets, round(tags / n, 6) AS avg_tags, round((SELECT count(*) FROM t WHERE label NOT IN (SELECT label FROM h)) / tags, 6) AS unclassified FROM n, c""")
def facet_summary(spark: SparkSession, d: str) -> DataFrame:
    """Brands as items, their parts' names as tags."""
    items = table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.collect_list("p_name").alias("tags"))
    return facets.summary(items, *_vocabulary(spark)).select("n", *[F.round(c, 6).alias(c) for c in ("avg_facets", "avg_tags", "unclassified")])


KEYS = f"t AS (SELECT user_id AS entity, epoch_us(ts) - {timeline.START} AS time_us, event_id FROM events), kf AS (SELECT DISTINCT entity, time_us FROM t WHERE event_id % 3 = 0), pt AS (SELECT DISTINCT entity, time_us FROM t WHERE event_id % 2 = 0)"


@query(f"""WITH {KEYS} SELECT pt.entity, pt.time_us, coalesce(bool_or(kf.time_us = pt.time_us), false) AS exact, max(kf.time_us) FILTER (WHERE kf.time_us < pt.time_us) AS previous_us, min(kf.time_us) FILTER (WHERE kf.time_us > pt.time_us) AS next_us
FROM pt LEFT JOIN kf ON kf.entity = pt.entity GROUP BY pt.entity, pt.time_us""")
def keyframe_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every third event of a user is a keyframe, every second one a point."""
    times = table(spark, d, "events").select(F.col("user_id").alias("entity"), timeline._us().alias("time_us"), "event_id")
    return intervals.keyframes_around(times.filter("event_id % 2 = 0"), times.filter("event_id % 3 = 0"))


@query(f"WITH {KEYS} SELECT entity, time_us, floor(time_us / 33333 + 0.5)::BIGINT AS frame, floor(time_us / 33333 + 0.5)::BIGINT * 33333 AS snapped_us FROM t")
def frame_snap(spark: SparkSession, d: str) -> DataFrame:
    times = table(spark, d, "events").select(F.col("user_id").alias("entity"), timeline._us().alias("time_us"))
    return intervals.frame_steps(times, 33_333)
