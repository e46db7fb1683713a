"""Vocabulary mining: terms of pages, their frequency, baselines, tiers of vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text


def page_terms(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and term of every raw term of each page, in normal form."""
    rows = pages.select(key, F.explode(text.html_terms(html)).alias("_raw"))
    return rows.select(key, text.mined_term("_raw").alias("term")).filter("term <> ''")


def frequencies(terms: DataFrame, key: str | None = None) -> DataFrame:
    """term and count; with a key, of distinct keys."""
    return (terms if key is None else terms.select(key, "term").distinct()).groupBy("term").agg(F.count("*").alias("count"))


def _display(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("label", text.title_case("term")).withColumn("prompt", F.format_string("a %s meme", "term")).withColumn("category", text.term_category("term"))


def baseline(counts: DataFrame, most: int = 1000, least: int = 2) -> DataFrame:
    """label, prompt, category, count of the most frequent terms; of a word and its plural the more frequent stays, of equals the first by name."""
    first = F.row_number().over(Window.partitionBy(text.stem_key("term")).orderBy(F.desc("count"), "term"))
    best = counts.filter(F.col("count") >= least).withColumn("_r", first).filter("_r = 1").orderBy(F.desc("count"), "term").limit(most)
    return _display(best).select("label", "prompt", "category", "count")


def multi_source_baseline(candidates: DataFrame, most: int = 1000) -> DataFrame:
    """The same from (term, weight, source): per stem the heaviest candidate, then the heaviest stems."""
    normal = candidates.withColumn("term", text.mined_term("term")).filter("term <> ''")
    first = F.row_number().over(Window.partitionBy(text.stem_key("term")).orderBy(F.desc("weight"), "term", "source"))
    best = normal.withColumn("_r", first).filter("_r = 1").orderBy(F.desc("weight"), "term").limit(most)
    return _display(best).select("label", "prompt", "category", "weight", "source")


def vocabulary(curated: DataFrame, *tiers: tuple[DataFrame, int]) -> DataFrame:
    """label, tier of the curated labels and of each tier's first labels (by ord) not in an earlier one, case aside."""
    rows = curated.select("label", F.lit(0).alias("tier"), "ord", F.lit(1 << 30).alias("_most"))
    for i, (tier, most) in enumerate(tiers, 1):
        rows = rows.unionByName(tier.select("label", F.lit(i).alias("tier"), "ord", F.lit(most).alias("_most")))
    own = rows.filter(F.trim("label") != "").withColumn("_r", F.row_number().over(Window.partitionBy(F.lower("label")).orderBy("tier", "ord", "label"))).filter("_r = 1")
    place = F.row_number().over(Window.partitionBy("tier").orderBy("ord", "label"))
    return own.withColumn("_p", place).filter("_p <= _most").select("label", "tier", "ord")


def sitemap_links(xml: DataFrame, column: str = "xml") -> DataFrame:
    return xml.select(F.explode(F.regexp_extract_all(column, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("url"))


def robots_disallowed(robots: DataFrame, column: str = "body") -> DataFrame:
    """Path prefixes that the rules for all agents forbid; each row is a file of its own."""
    lines = robots.select(F.monotonically_increasing_id().alias("file"), column).select("file", F.posexplode(F.split(column, r"\r?\n")).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*", "")))
    agent = F.when(F.lower("line").startswith("user-agent:"), F.trim(F.substring_index("line", ":", -1)))
    current = F.last(agent, ignorenulls=True).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rules = lines.withColumn("agent", current).filter((F.col("agent") == "*") & F.lower("line").startswith("disallow:"))
    return rules.select(F.trim(F.regexp_replace("line", "(?i)^disallow:", "")).alias("prefix")).filter("prefix <> ''")


def facet_coverage(items: DataFrame, keywords: DataFrame) -> DataFrame:
    """facet, items, share: items with a tag of the facet. ``keywords``: word, facet, a small vocabulary of single words.

    A tag's words meet the vocabulary in an equi-join.
    """
    total = items.agg(F.count("*").alias("_n"))
    return _coverage(items.select("id", F.explode("tags").alias("t")).select("id", "t.label"), total, keywords)


def facet_coverage_rows(tagged: DataFrame, keywords: DataFrame) -> DataFrame:
    """facet_coverage() of a row for each tag: id, label."""
    return _coverage(tagged.select("id", "label").distinct(), tagged.agg(F.count_distinct("id").alias("_n")), keywords)


def _coverage(labels: DataFrame, total: DataFrame, keywords: DataFrame) -> DataFrame:
    tag_words = labels.select("id", F.explode(F.array_distinct(F.split(F.lower("label"), "[^a-z0-9]+"))).alias("word"))
    hits = tag_words.join(keywords, "word").select("id", "facet").distinct().groupBy("facet").agg(F.count("*").alias("items"))
    return hits.crossJoin(F.broadcast(total)).select("facet", "items", (F.col("items") / F.col("_n")).alias("share"))


def tag_histogram(items: DataFrame, top: int = 40) -> DataFrame:
    counted = items.select(F.explode("tags").alias("t")).select(text.label("t.label").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "label").limit(top)
