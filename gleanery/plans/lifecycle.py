"""Paging, anti-joins, upserts, queues, mirrors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import hashing, records
from gleanery.operators import merge, paging, rollups
from gleanery.plans.register import query
from gleanery.sources import files, mirror
from gleanery.sources.tables import table


@query("""SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS modified_at, o_totalprice FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-15' AND (o_orderdate < TIMESTAMP '1996-06-15' OR o_orderkey < 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 90""")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", "o_totalprice")
    page = paging.before(rows, F.lit("1996-06-15").cast("timestamp"), 5000, time="o_orderdate")
    return page.select("id", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("modified_at"), "o_totalprice")


@query("SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 90 OFFSET 180")
def recent_page(spark: SparkSession, d: str) -> DataFrame:
    return paging.recent(table(spark, d, "orders"), offset=180, time="o_orderdate", key="o_orderkey").select(F.col("o_orderkey").alias("id"), "o_totalprice")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_new(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT vec_id AS uri FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_sweep(spark: SparkSession, d: str) -> DataFrame:
    return files.orphans(table(spark, d, "embeddings").select(F.col("vec_id").alias("uri")), table(spark, d, "labels").select(F.col("doc_id").alias("uri")))


def _live(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("uri"), "source", F.col("lang").alias("kind"), F.when(F.col("lang") == "en", "").otherwise(F.col("source")).alias("caption"), F.when(F.col("lang") == "de", "").otherwise(F.lit("poster")).alias("thumb_uri"),
        F.when(F.col("lang") == "fr", "done").otherwise(F.lit("pending")).alias("vision_state"), F.when(F.col("lang") == "es", "done").otherwise(F.lit("pending")).alias("audio_state"), F.col("n_chars").alias("indexed_at"), (F.col("lang") == "en").alias("pending"),
    ).drop("source").withColumn("transcript", F.lit(""))


LIVE = """live AS (SELECT doc_id AS uri, lang AS kind, CASE WHEN lang = 'en' THEN '' ELSE source END AS caption, CASE WHEN lang = 'de' THEN '' ELSE 'poster' END AS thumb_uri,
  CASE WHEN lang = 'fr' THEN 'done' ELSE 'pending' END AS vision_state, CASE WHEN lang = 'es' THEN 'done' ELSE 'pending' END AS audio_state, n_chars AS indexed_at, lang = 'en' AS pending, '' AS transcript FROM documents)"""
SCANNED = "scanned AS (SELECT page_id * 5 AS uri, 'web' AS kind, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'new' END AS thumb_uri, 'failed' AS vision_state, 'none' AS audio_state, page_id AS indexed_at, '' AS caption, 'said' AS transcript FROM pages)"


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    return table(spark, d, "pages").select((p * 5).alias("uri"), F.lit("web").alias("kind"), F.when(p % 2 == 0, "").otherwise("new").alias("thumb_uri"), F.lit("failed").alias("vision_state"), F.lit("none").alias("audio_state"), p.alias("indexed_at"))


@query(f"""WITH {LIVE}, {SCANNED} SELECT coalesce(l.uri, s.uri) AS uri, CASE WHEN s.uri IS NULL THEN l.kind ELSE s.kind END AS kind, coalesce(l.caption, '') AS caption,
CASE WHEN s.uri IS NULL THEN l.thumb_uri WHEN l.uri IS NULL THEN s.thumb_uri WHEN s.thumb_uri = '' THEN l.thumb_uri ELSE s.thumb_uri END AS thumb_uri,
CASE WHEN s.uri IS NULL THEN l.vision_state WHEN l.uri IS NULL OR l.caption = '' THEN s.vision_state ELSE l.vision_state END AS vision_state,
CASE WHEN s.uri IS NULL OR l.audio_state = 'done' THEN l.audio_state ELSE s.audio_state END AS audio_state,
CASE WHEN s.uri IS NULL THEN l.indexed_at ELSE s.indexed_at END AS indexed_at, CASE WHEN s.uri IS NULL THEN l.pending ELSE false END AS pending, '' AS transcript FROM live l FULL JOIN scanned s ON l.uri = s.uri""")
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    return merge.index_upsert(_live(spark, d), _scanned(spark, d))


@query(f"""WITH {LIVE}, {SCANNED}, saved AS (SELECT uri, kind, 'saved' AS caption, thumb_uri, 'done' AS vision_state, audio_state, indexed_at, false AS pending, transcript FROM scanned)
SELECT coalesce(l.uri, s.uri) AS uri, coalesce(l.kind, s.kind) AS kind, CASE WHEN l.uri IS NULL OR (l.caption = '' AND s.uri IS NOT NULL) THEN s.caption ELSE l.caption END AS caption, coalesce(l.thumb_uri, s.thumb_uri) AS thumb_uri,
CASE WHEN l.uri IS NULL OR (l.caption = '' AND s.uri IS NOT NULL) THEN s.vision_state ELSE l.vision_state END AS vision_state, CASE WHEN s.uri IS NULL OR l.audio_state = 'done' THEN l.audio_state ELSE s.audio_state END AS audio_state,
coalesce(l.indexed_at, s.indexed_at) AS indexed_at, coalesce(l.pending, s.pending) AS pending, CASE WHEN s.uri IS NULL THEN l.transcript ELSE s.transcript END AS transcript FROM live l FULL JOIN saved s ON l.uri = s.uri""")
def additive_restore(spark: SparkSession, d: str) -> DataFrame:
    saved = _scanned(spark, d).withColumns({"caption": F.lit("saved"), "vision_state": F.lit("done"), "pending": F.lit(False), "transcript": F.lit("said")})
    return merge.additive_restore(_live(spark, d), saved)


@query(f"WITH {LIVE}, {SCANNED} SELECT count(*) FILTER (WHERE l.uri IS NULL) AS added, count(*) FILTER (WHERE l.uri IS NOT NULL) AS enriched FROM scanned s LEFT JOIN live l ON l.uri = s.uri")
def restore_counts(spark: SparkSession, d: str) -> DataFrame:
    return merge.restore_counts(_live(spark, d), _scanned(spark, d))


@query(f"""WITH {LIVE} SELECT count(*) AS total, count(*) FILTER (WHERE vision_state = 'done') AS described, count(*) FILTER (WHERE vision_state = 'pending' AND NOT pending) AS waiting, count(*) FILTER (WHERE vision_state = 'failed' AND NOT pending) AS failed,
count(*) FILTER (WHERE pending) AS indexing, count(*) FILTER (WHERE transcript <> '') AS transcribed FROM live""")
def stats_countif(spark: SparkSession, d: str) -> DataFrame:
    return merge.vision_stats(_live(spark, d))


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def keep_latest(spark: SparkSession, d: str) -> DataFrame:
    last = merge.keep_latest(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return last.select("user_id", "event_type", "event_id", "value")


@query("""WITH e AS (SELECT page_id AS ord, url AS path, string_split(split_part(url, '?', 1), '/')[-1] || ['.jpg', '.mp4', '.txt'][1 + page_id % 3] AS name FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS r FROM e)
SELECT ord, name, CASE WHEN name LIKE '%.txt' THEN 'unsupported' WHEN r > 1 OR name IN (SELECT name FROM e WHERE ord < 20) THEN 'duplicate' ELSE 'import' END AS verdict FROM n WHERE name <> ''""")
def zip_plan(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses as a zip's listing; the first twenty names are in the library already."""
    ends = F.array(F.lit(".jpg"), F.lit(".mp4"), F.lit(".txt"))
    rows = table(spark, d, "pages").select(F.col("page_id").alias("ord"), F.concat(F.substring_index("url", "?", 1), F.get(ends, (F.col("page_id") % 3).cast("int"))).alias("path"), F.lit(False).alias("is_dir"))
    known = rows.filter("ord < 20").select(F.substring_index("path", "/", -1).alias("name"))
    return files.zip_plan(rows, known).select("ord", "name", "verdict")


FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({t}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"SELECT doc_id, {FNV.format(t='text')} AS hash FROM documents")
def content_hash_fnv(spark: SparkSession, d: str) -> DataFrame:
    """Of whole texts; they hold no character of two units, for which the SQL would differ."""
    return table(spark, d, "documents").select("doc_id", hashing.fnv1a("text").alias("hash"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("name", F.concat_ws("/", "source", "lang", "doc_id"))


@query(f"SELECT lpad(lower(to_hex({FNV.format(t="(source || '/' || lang || '/' || doc_id)")} % 64)), 2, '0') AS chunk, count(*) AS rows FROM documents GROUP BY 1")
def mirror_chunks(spark: SparkSession, d: str) -> DataFrame:
    return mirror.manifest(mirror.chunks(_named(spark, d))).select("chunk", "rows")


@query(None)
def mirror_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digests of whole documents; Spark's hashes have no SQL, a test holds them against Python's."""
    return mirror.manifest(mirror.chunks(_named(spark, d)))


@query("SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS hash FROM documents")
def text_hash31(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", hashing.text_hash31("text").alias("hash"))


@query("""SELECT doc_id FROM (SELECT doc_id, list_transform(string_split(sha1(doc_id::VARCHAR), ''), lambda h: strpos('0123456789abcdef', h) - 1) AS x FROM documents) WHERE x[40] % 4 = 0 AND list_sum(x) % 5 = 0""")
def held_out_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").filter(records.held_out(F.col("doc_id").cast("string")))


@query("SELECT source AS pack, count(DISTINCT lang) AS labels, count(*) AS examples FROM documents GROUP BY source")
def pack_rollup(spark: SparkSession, d: str) -> DataFrame:
    examples = table(spark, d, "documents").select(F.col("lang").alias("label"), F.col("source").alias("pack"), F.lit("pack").alias("origin"))
    return rollups.packs(examples)


@query("""WITH t AS (SELECT d.lang AS label, count(*) FILTER (WHERE quality = 1) AS positives, count(*) FILTER (WHERE quality = 0) AS negatives, bool_or(toxic = 1) AS from_self, bool_or(toxic = 0) AS from_pack FROM labels JOIN documents d USING (doc_id) GROUP BY d.lang)
SELECT t.*, (SELECT count(*) FROM documents d WHERE d.lang = t.label) AS tagged FROM t""")
def taught_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    examples = table(spark, d, "labels").join(docs, "doc_id").select(F.col("lang").alias("label"), (F.col("quality") == 1).alias("is_positive"), F.when(F.col("toxic") == 1, "self").otherwise("pack").alias("origin"), F.lit("").alias("pack"))
    items = docs.select(F.col("doc_id").alias("id"), F.array(F.struct(F.col("lang").alias("label"))).alias("tags"))
    return rollups.taught_labels(examples, items).drop("packs")


@query("SELECT user_id, max_by(props, (ts, event_id)) AS value FROM events GROUP BY user_id")
def settings_latest(spark: SparkSession, d: str) -> DataFrame:
    """Key and value, last writer wins."""
    return merge.keep_latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("props").alias("value"))


@query("""WITH a AS (SELECT c_custkey AS id, c_acctbal FROM customer), b AS (SELECT o_custkey AS id, max(o_totalprice) AS c_acctbal FROM orders GROUP BY o_custkey)
SELECT a.id, coalesce(b.c_acctbal, a.c_acctbal) AS c_acctbal FROM a LEFT JOIN b USING (id)""")
def patch_by_id(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return merge.patch(a, table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("c_acctbal")), "id", "c_acctbal")


@query("SELECT o_orderkey AS id, o_orderstatus FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE q > 250")
def heavy_orders(spark: SparkSession, d: str) -> DataFrame:
    """An equi-join after an aggregate: partial sums are combined before the shuffle."""
    heavy = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("q")).filter("q > 250")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus").join(heavy.select("id"), "id")
