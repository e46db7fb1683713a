"""Terms of pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.operators import mining
from gleanery.plans.register import query
from gleanery.sources import harvest
from gleanery.sources.tables import table

NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(w), '[''’`]', '', 'g'), '[_/]+', ' ', 'g'), '[^a-z0-9 +-]+', ' ', 'g'), '\s+', ' ', 'g'))"""
SINGLE = "CASE WHEN contains({t}, ' ') THEN array_to_string(list_filter(string_split({t}, ' '), lambda x: len(x) > 1), ' ') ELSE {t} END"
GOOD = r"""len(t) >= 3 AND len(t) <= 40 AND NOT regexp_matches(t, '^\d+$') AND len(string_split(t, ' ')) <= 6 AND NOT regexp_matches(t, '^object( object)*$')
 AND len(list_filter(string_split(t, ' '), lambda x: (regexp_matches(x, '[a-z]') AND regexp_matches(x, '\d')) OR regexp_matches(x, '^\d{4,}$'))) = 0
 AND (contains(t, ' ') OR (len(t) >= 4 AND NOT regexp_matches(t, '\d') AND regexp_matches(t, '[aeiouy]')))"""
WORDS = f"w AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w FROM documents), n AS (SELECT w, {NORMAL} AS t0 FROM (SELECT DISTINCT w FROM w)), k AS (SELECT w, t FROM (SELECT w, {SINGLE.format(t='t0')} AS t FROM n) WHERE {GOOD}), f AS (SELECT t AS term, count(DISTINCT doc_id) AS count FROM w JOIN k USING (w) GROUP BY t)"


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Documents a term is in. A document's terms become distinct within its row, so one partial count by term is all that moves."""
    found = F.array_distinct(F.transform(F.array_distinct(F.split("text", r"\s+")), lambda w: text.mined_term(w)))
    return mining.frequencies(table(spark, d, "documents").select(F.explode(found).alias("term")).filter("term <> ''"))


@query(f"WITH {WORDS} SELECT term, count FROM f WHERE count >= 3")
def mined_terms(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).filter("count >= 3")


STEM = "CASE WHEN len(term) > 3 AND term LIKE '%s' THEN term[:-2] ELSE term END"


@query(f"""WITH {WORDS}, s AS (SELECT *, row_number() OVER (PARTITION BY {STEM} ORDER BY count DESC, term) AS r FROM f WHERE count >= 2), b AS (SELECT term, count FROM s WHERE r = 1 ORDER BY count DESC, term LIMIT 1000)
SELECT array_to_string(list_transform(string_split(term, ' '), lambda x, i: CASE WHEN i > 1 AND len(x) <= 2 THEN x ELSE upper(x[1]) || x[2:] END), ' ') AS label, 'a ' || term || ' meme' AS prompt, count FROM b""")
def mine_baseline(spark: SparkSession, d: str) -> DataFrame:
    return mining.baseline(_frequencies(spark, d)).select("label", "prompt", "count")


@query("SELECT link, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS link FROM pages) GROUP BY link")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1))).alias("link"))
    return links.groupBy("link").agg(F.count_distinct("page_id").alias("pages"))


@query("""SELECT page_id, regexp_extract(html, '(?i)<meta[^>]+charset=["'']([^"'']+)["'']', 1) AS charset, regexp_extract(html, '(?i)<html[^>]+lang=["'']([^"'']+)["'']', 1) AS lang,
replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS title FROM pages""")
def html_meta(spark: SparkSession, d: str) -> DataFrame:
    h = "html"
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(h, """(?i)<meta[^>]+charset=["']([^"']+)["']""", 1).alias("charset"), F.regexp_extract(h, """(?i)<html[^>]+lang=["']([^"']+)["']""", 1).alias("lang"), text.decode_entities(F.regexp_extract(h, "(?s)<title>(.*?)</title>", 1)).alias("title")
    )


@query(r"SELECT page_id, regexp_replace(regexp_extract('see ' || url || ').', '(https?://\S+)', 1), '[)\].,]+$', '') AS url, lower(string_split(url, '.')[-1]) AS ending FROM pages")
def first_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.first_url(F.concat(F.lit("see "), "url", F.lit(")."))).alias("url"), text.ending("url").alias("ending"))


@query("""SELECT conv_id, count(*) AS turns, len(list_distinct(list_filter(string_split_regex(string_agg(text, ' ' ORDER BY turn), '\\s+'), lambda w: w <> ''))) AS terms FROM conversations GROUP BY conv_id""")
def union_terms(spark: SparkSession, d: str) -> DataFrame:
    """The distinct terms of a conversation."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.explode_outer(text.words("text")).alias("w"))
    return turns.groupBy("conv_id").agg(F.count_distinct("turn").alias("turns"), F.count_distinct("w").alias("terms"))


@query("""WITH c(label, ord) AS (SELECT r_name, r_regionkey FROM region), t AS (SELECT label, 0 AS tier, ord, 99999999 AS most FROM c UNION ALL SELECT n_name, 1, n_nationkey, 10 FROM nation UNION ALL SELECT p_brand, 2, min(p_partkey), 5 FROM part GROUP BY p_brand),
o AS (SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY tier, ord, label) AS r FROM t WHERE trim(label) <> ''), p AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY ord, label) AS place FROM o WHERE r = 1) SELECT label, tier, ord FROM p WHERE place <= most""")
def vocabulary_tiers(spark: SparkSession, d: str) -> DataFrame:
    named = lambda t, label, ord: table(spark, d, t).groupBy(F.col(label).alias("label")).agg(F.min(ord).cast("long").alias("ord"))
    return mining.vocabulary(named("region", "r_name", "r_regionkey"), (named("nation", "n_name", "n_nationkey"), 10), (named("part", "p_brand", "p_partkey"), 5))


@query("""WITH e AS (SELECT doc_id AS page, unnest([{'name': source || ' ' || lang, 'slug': '', 'tags': [lang, source]}, {'name': '', 'slug': 'n-' || (n_chars % 50), 'tags': [source]}]) AS e, unnest([0, 1]) AS place FROM documents),
n AS (SELECT CASE WHEN e.name = '' THEN replace(e.slug, '-', ' ') ELSE e.name END AS term, 100001 - row_number() OVER (ORDER BY page, place) AS weight FROM e), t AS (SELECT term, count(*) AS weight FROM (SELECT page, place, unnest(list_distinct(e.tags)) AS term FROM e) GROUP BY term HAVING count(*) >= 2),
u AS (SELECT * FROM n UNION ALL SELECT * FROM t) SELECT term, max(weight) AS weight FROM u GROUP BY term""")
def harvested_names(spark: SparkSession, d: str) -> DataFrame:
    """Documents as wrapped lists of two entries, one named and one with a slug; each term's heaviest candidate."""
    entry = lambda name, slug, *tags: F.struct(name.alias("name"), slug.alias("slug"), F.array(*tags).alias("tags"))
    listed = F.array(entry(F.concat_ws(" ", "source", "lang"), F.lit(""), "lang", "source"), entry(F.lit(""), F.concat(F.lit("n-"), (F.col("n_chars") % 50).cast("string")), "source"))
    pages = table(spark, d, "documents").select(F.lit("named").alias("source"), F.col("doc_id").alias("page"), F.to_json(F.struct(F.lit("ok").alias("status"), listed.alias("results"))).alias("payload"))
    return harvest.heaviest(harvest.candidates(pages, harvest.NAMED)).select("term", F.col("weight").cast("long").alias("weight"))


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)href=["\'']/([a-z0-9][a-z0-9-]*)["\'']', 1) AS s FROM pages), f AS (SELECT lower(unnest(s)) AS s, page_id, generate_subscripts(s, 1) AS p FROM l), o AS (SELECT s, min(page_id * 1000000 + p) AS a0 FROM f WHERE s <> 'the' GROUP BY s)
SELECT regexp_replace(s, '-+', ' ', 'g') AS term, 100001 - row_number() OVER (ORDER BY a0) AS weight FROM o""")
def harvested_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Links of the pages as slugs, by their first place."""
    pages = table(spark, d, "pages").select(F.lit("site").alias("source"), F.col("page_id").alias("page"), F.col("html").alias("payload"))
    return harvest.slug_candidates(pages, "site", "/", ("the",)).select("term", F.col("weight").cast("long").alias("weight"))
