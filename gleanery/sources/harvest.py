"""Harvested payloads of any shape as candidates for a vocabulary: term, weight, source.

Payloads are JSON texts or pages of HTML, one row each (source, page, payload); nothing is known of them but where a source keeps its list, names and tags (``Adapter``). They are walked as VARIANT values, so no schema is needed. Names weigh
``NAME_BASE`` less their place, counted over all pages of a source in order; tags weigh how many entries have them.

A payload that is no JSON, or holds no list, gives nothing; entries without a name too. Where a wrapper has none of the keys its first list by name counts, since a VARIANT's fields have no other order. A null page comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.vectors import let
from gleanery.operators import ranking

#: What keeps names above all tags, entries that a tag must be on, weights of plain lists and of lists inside entries.
NAME_BASE, TAG_ENTRIES, PLAIN, INNER = 100_000, 2, 3, 2
#: Fields that name a term, and endings that are no tags.
TERM_FIELDS = ("name", "title", "label", "slug", "tag", "text", "value")
FORMATS = ("png", "gif", "jpg", "jpeg", "webp", "mp4", "webm", "apng", "svg", "image", "video")
LIST = "array<variant>"


@dataclass(frozen=True)
class Adapter:
    """Where a source keeps things: wrapper keys of its list, fields that name an entry (the first that is a text), a field with a slug instead, a list of tags, a list of entries below an entry, and the weight of names (by place if None)."""

    source: str
    keys: tuple[str, ...] = ()
    names: tuple[str, ...] = ("name",)
    slug: str | None = None
    tags: str | None = None
    inner: str | None = None
    weight: int | None = None


#: The field names of known kinds of payloads.
NAMED = Adapter("named", ("depots", "memes", "data", "results", "items"), ("name", "title", "displayName", "label"), "slug", "tags")
TEMPLATES = Adapter("templates", ("memes", "data"))
CATEGORIES = Adapter("categories", ("data",), inner="subcategories", weight=PLAIN)
TERMS = Adapter("terms", ("tags",), ("searchterm", "name"), weight=INNER)


def _text(value: Column, path: str) -> Column:
    """A text at ``path``; null for anything else there."""
    found = F.trim(F.try_variant_get(value, path, "string"))
    return F.when((F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING") & (found != ""), found)


def unwrapped(payload: Column, keys: tuple[str, ...] = ()) -> Column:
    """The list in a JSON text: itself, that of the first key that holds one (looked for at the top, then in the fields' own objects), or the first list there is; empty without any."""

    def lists(tree: Column) -> Column:
        itself = F.try_variant_get(tree, "$", LIST)
        keyed = [F.try_variant_get(tree, f"$.{k}", LIST) for k in keys] + [F.try_variant_get(tree, f"$.{a}.{b}", LIST) for a in keys for b in keys if a != b]
        fields = F.map_values(F.try_variant_get(tree, "$", "map<string,variant>"))
        any_list = F.get(F.filter(F.transform(fields, lambda v: F.try_variant_get(v, "$", LIST)), lambda x: x.isNotNull()), F.lit(0))
        return F.coalesce(itself, *keyed, any_list, F.array().cast(LIST))

    return let(F.try_parse_json(F.coalesce(payload, F.lit(""))), lists)


def entry_name(entry: Column, adapter: Adapter) -> Column:
    """An entry's name, or its slug as words; empty without either."""
    slug = [] if adapter.slug is None else [F.nullif(F.trim(F.regexp_replace(_text(entry, f"$.{adapter.slug}"), "[-_]+", " ")), F.lit(""))]
    return F.coalesce(*[_text(entry, f"$.{n}") for n in adapter.names], *slug, F.lit(""))


def tag_term(value: Column) -> Column:
    """A tag: a text itself, or the first naming field of an object; empty for anything else."""
    return F.coalesce(_text(value, "$"), *[_text(value, f"$.{f}") for f in TERM_FIELDS], F.lit(""))


def entries(payloads: DataFrame, adapter: Adapter) -> DataFrame:
    """page, place and entry of a source's pages."""
    own = payloads.filter(F.col("source") == adapter.source)
    return own.select("page", F.posexplode(unwrapped(F.col("payload"), adapter.keys)).alias("place", "entry"))


def _ranked(rows: DataFrame, order: list[Column], source: str) -> DataFrame:
    """term, weight and source of rows with a term, by their place in ``order``."""
    placed = ranking.ranked(rows, [], order)
    return placed.select("term", (F.lit(NAME_BASE + 1) - F.col("rank")).alias("weight"), F.lit(source).alias("source"))


def candidates(payloads: DataFrame, adapter: Adapter) -> DataFrame:
    """term, weight, source of a source's JSON pages: names by place (an entry without one takes a place too), tags by entries, entries below entries."""
    # VARIANT values can't be sorted, so they are read before rows are ranked
    read = entries(payloads, adapter).withColumn("term", entry_name(F.col("entry"), adapter))
    if adapter.weight is None:
        names = _ranked(read.select("page", "place", "term"), [F.col("page"), F.col("place"), F.col("term")], adapter.source)
    else:
        names = read.select("term", F.lit(adapter.weight).cast("long").alias("weight"), F.lit(adapter.source).alias("source"))
    out = names
    if adapter.inner is not None:
        below = read.select(F.explode(F.try_variant_get("entry", f"$.{adapter.inner}", LIST)).alias("entry"))
        out = out.unionByName(below.select(entry_name(F.col("entry"), adapter).alias("term"), F.lit(INNER).cast("long").alias("weight"), F.lit(adapter.source).alias("source")))
    if adapter.tags is not None:
        listed = F.transform(F.coalesce(F.try_variant_get("entry", f"$.{adapter.tags}", LIST), F.array().cast(LIST)), tag_term)
        out = out.unionByName(_tags(read.select(F.explode(F.array_distinct(listed)).alias("term")), adapter.source))
    return out.filter("term <> ''")


def _tags(terms: DataFrame, source: str) -> DataFrame:
    return terms.groupBy("term").agg(F.count("*").alias("weight")).filter(F.col("weight") >= TAG_ENTRIES).select("term", "weight", F.lit(source).alias("source"))


def slug_candidates(payloads: DataFrame, source: str, prefix: str, skipped: tuple[str, ...] = ()) -> DataFrame:
    """term, weight, source of links ``prefix`` + slug in HTML pages: each slug once, by its first place over all pages in order, as words."""
    own = payloads.filter(F.col("source") == source)
    found = own.select("page", F.posexplode(F.regexp_extract_all(F.coalesce("payload", F.lit("")), F.lit(rf"""(?i)href=["']{prefix}([a-z0-9][a-z0-9-]*)["']"""), 1)).alias("place", "_s")).withColumn("_s", F.lower("_s"))
    first = found.filter(~F.col("_s").isin(*skipped) if skipped else F.lit(True)).groupBy("_s").agg(F.min(F.struct("page", "place")).alias("_at"))
    rows = first.select(F.regexp_replace("_s", "-+", " ").alias("term"), F.col("_at.page").alias("page"), F.col("_at.place").alias("place"))
    return _ranked(rows, [F.col("page"), F.col("place"), F.col("term")], source)


def folder_label(folder: Column) -> Column:
    """A folder's name without a ticker's sign before it and the noun after it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(folder, F.lit("")), r"^\$+", ""), r"(?i)\s+memes?$", ""))


def folder_candidates(payloads: DataFrame, adapter: Adapter, folder: str = "folder") -> DataFrame:
    """term, weight, source of entries in folders: folders by how many entries they hold (of equals by name), tags but for file formats by entries."""
    read = entries(payloads, adapter).select(folder_label(_text(F.col("entry"), f"$.{folder}")).alias("term"), F.array_distinct(F.transform(F.coalesce(F.try_variant_get("entry", f"$.{adapter.tags or 'tags'}", LIST), F.array().cast(LIST)), tag_term)).alias("_tags"))
    counted = read.filter("term <> ''").groupBy("term").agg(F.count("*").alias("n"))
    tags = read.select(F.explode(F.filter("_tags", lambda t: (t != "") & ~F.lower(F.trim(t)).isin(*FORMATS))).alias("term"))
    return _ranked(counted, [F.desc("n"), F.col("term")], adapter.source).unionByName(_tags(tags, adapter.source))


def heaviest(rows: DataFrame) -> DataFrame:
    """Of candidates with one term and source the heaviest."""
    first = F.row_number().over(Window.partitionBy("term", "source").orderBy(F.desc("weight")))
    return rows.withColumn("_r", first).filter("_r = 1").drop("_r")
