"""Ranked retrieval: scope, scores, tag boost, rank fusion, BM25, label expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import tags as T
from gleanery.functions import text, vectors
from gleanery.functions.vectors import col
from gleanery.operators import ranking
from gleanery.sources import tables

#: Weights of lexical hits, of all terms hit, of expanded terms; of tag hits and all tag hits; of fused lists.
LEXICAL, ALL_TERMS, EXPANDED, EXPANDED_FULL = 0.35, 0.6, 0.22, 2
TAG_SHARE, TAG_ALL = 2.5, 3.0
RRF_K, DENSE_WEIGHT, LEXICAL_WEIGHT = 60, 1.0, 2.0
EXPANSION_LEAST, EXPANSION_TOP = 0.24, 6
#: BM25 weights of ocr, name, caption, transcript, tags, extra terms.
BM25_FIELDS = (1.0, 1.2, 2.0, 1.8, 5.0, 4.0)


def term_score(hay: Column | str, exact: Column | str, expanded: Column | str | None = None) -> Column:
    """Lexical part of a score: share of exact terms found, a bonus for all of them, and up to two expanded ones."""
    n, hit = F.size(col(exact)), text.matched_terms(hay, exact)
    out = F.when(n > 0, LEXICAL * hit / n + F.when(hit == n, ALL_TERMS).otherwise(0.0)).otherwise(0.0)
    if expanded is not None:
        more = text.matched_terms(hay, expanded)
        out = out + F.when(more > 0, EXPANDED * F.least(F.lit(1.0), more / EXPANDED_FULL)).otherwise(0.0)
    return out


def entry_score(query: Column | str | None, exact: Column | str, image: Column | str, caption: Column | str, hay: Column | str, expanded: Column | str | None = None) -> Column:
    """Hybrid similarity (0 without a query vector) plus the lexical part."""
    dense = F.lit(0.0) if query is None else F.coalesce(vectors.hybrid_score(query, image, caption), F.lit(0.0))
    return dense + term_score(hay, exact, expanded)


def tag_score(tag_hay: Column | str, exact: Column | str) -> Column:
    """Share of exact terms found in the tag labels, with a bonus for all; 0 if none."""
    n, hit = F.size(col(exact)), text.matched_terms(tag_hay, exact)
    return F.when((n > 0) & (hit > 0), TAG_SHARE * hit / n + F.when(hit == n, TAG_ALL).otherwise(0.0)).otherwise(0.0)


def scope(items: DataFrame, kind: str | None, query: str) -> DataFrame:
    """Items of a kind; all of them if none is of that kind and there is a query. One aggregate decides, within the plan."""
    if kind is None:
        return items
    wanted = F.coalesce(F.col("kind") == kind, F.lit(False))
    if not query.strip():
        return items.filter(wanted)
    any_there = items.agg(F.coalesce(F.bool_or(wanted), F.lit(False)).alias("_any"))
    return items.join(F.broadcast(any_there), ~F.col("_any") | wanted).drop("_any")


def fuse(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rows (list, id, rank, weight): id, rrf_score, and the least (list, rank) as first-seen order."""
    seen = F.min(F.struct("list", "rank")).alias("seen")
    return lists.groupBy("id").agg(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))).alias("rrf_score"), seen)


def ranked(df: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """The first ``limit`` rows (all if None) with their 1-based rank. Only what is cut to a limit is numbered by one task."""
    if limit is None:
        return ranking.ranked(df, [], order)
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def search(items: DataFrame, query_vector: list[float] | None, query: str, *, limit: int = 40, kind: str | None = None, expanded: list[str] | None = None, lexical: str = "scan", hits: DataFrame | None = None) -> DataFrame:
    """id, hybrid_score, rrf_score, rank of the best items.

    ``items``: id, kind, embedding, caption_embedding, search_text (lower case), tags, modified_at. With ``lexical="scan"`` terms and expansions are part of
    the score and there is one ranked list; with ``"bm25"`` they are left to a second list that weighs double: ``hits`` (id, bm25) of an index, or what a scan of search_text finds. The list is cut
    to the best rows before anything is numbered, so no more than these go to one task.
    """
    chosen = scope(items, kind, query)
    # literals, folded at planning; short words only count when nothing else is left to search by
    words = query.lower().split()
    exact = [w for w in words if len(w) > 2] or ([w for w in words if w] if query_vector is None else [])
    terms = F.array(*[F.lit(w) for w in exact]) if exact else F.array().cast("array<string>")
    more = F.array(*[F.lit(w) for w in expanded]) if expanded else None
    q = None if query_vector is None else F.array(*[F.lit(float(x)) for x in query_vector])
    plain = lexical == "bm25"
    score = entry_score(q, F.array().cast("array<string>") if plain else terms, "embedding", "caption_embedding", "search_text", None if plain else more)
    scored = chosen.select("id", "modified_at", "search_text", (score + tag_score(T.tag_haystack("tags"), terms)).alias("hybrid_score"))
    order = [F.desc("hybrid_score"), F.desc("modified_at"), F.desc("id")]
    if not plain:
        top = ranked(scored.select("id", "modified_at", "hybrid_score"), order, limit)
        return top.select("id", "hybrid_score", (F.lit(DENSE_WEIGHT) / (F.lit(RRF_K) + F.col("rank"))).alias("rrf_score"), "rank")
    hits = bm25(chosen, ["search_text"], [1.0], exact + (expanded or [])) if hits is None else hits.join(chosen.select("id"), "id", "left_semi")
    lexical_list = ranking.ranked(hits, [], [F.desc("bm25"), F.asc("id")]).select("id", F.lit(1).alias("list"), "rank", F.lit(LEXICAL_WEIGHT).alias("weight"))
    dense_list = ranking.ranked(scored.drop("search_text"), [], order).select("id", F.lit(0).alias("list"), "rank", F.lit(DENSE_WEIGHT).alias("weight"))
    fused = fuse(dense_list.unionByName(lexical_list)).join(scored.drop("search_text"), "id")
    return ranked(fused, [F.desc("rrf_score"), *order], limit).select("id", "hybrid_score", "rrf_score", "rank")


def bm25(items: DataFrame, fields: list[str], weights: list[float], terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and bm25 of items that hold a term (a token, or several tokens in a row) in a field.

    Term frequencies are counted where the row is; only totals (document frequencies and the mean length) are gathered, a row of them.
    """
    terms = [" ".join(t.split()) for t in dict.fromkeys(terms) if t.split()]
    if not terms:
        return items.select("id").limit(0).withColumn("bm25", F.lit(0.0))
    padded = [F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(f), F.lit(""))), r"[^\p{L}\p{N}]+", "  ")), F.lit(" ")) for f in fields]
    length = sum((F.size(F.filter(F.split(p, " +"), lambda w: w != "")) for p in padded), F.lit(0))
    # a token has a blank of its own on either side, so neighbours of one term don't share one
    needle = [" " + "  ".join(t.split()) + " " for t in terms]
    count = lambda p, n: (F.length(p) - F.length(F.replace(p, F.lit(n), F.lit("")))) / F.lit(len(n))
    tf = [sum((F.lit(w) * count(p, n) for w, p in zip(weights, padded)), F.lit(0.0)).alias(f"_tf{i}") for i, n in enumerate(needle)]
    rows = items.select("id", length.alias("_len"), *tf)
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    idf = lambda i: F.greatest(F.lit(1e-6), F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)))
    part = lambda i: idf(i) * F.col(f"_tf{i}") * (k1 + 1) / (F.col(f"_tf{i}") + k1 * (1 - b + b * F.col("_len") / F.col("_mean")))
    any_hit = F.greatest(*[F.col(f"_tf{i}") for i in range(len(terms))], F.lit(0.0)) > 0
    return rows.crossJoin(F.broadcast(stats)).filter(any_hit).select("id", sum((part(i) for i in range(len(terms))), F.lit(0.0)).alias("bm25"))


def expansion_candidates(vocabulary: DataFrame) -> DataFrame:
    """One candidate a label (case aside), the first by source: curated, taught, library. ``vocabulary``: label, terms, vector, source."""
    priority = F.when(F.col("source") == "curated", 0).when(F.col("source") == "taught", 1).otherwise(2)
    w = Window.partitionBy(F.lower("label")).orderBy(priority, "label")
    return vocabulary.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def semantic_labels(candidates: DataFrame, query_vector: list[float], least: float = EXPANSION_LEAST, top: int = EXPANSION_TOP) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    return candidates.withColumn("score", vectors.dot("vector", q)).filter(F.col("score") >= least).orderBy(F.desc("score"), "label").limit(top)


def expanded_terms(hits: DataFrame, exact: list[str]) -> DataFrame:
    """One row with the terms of all hits, best label first, each once, without the exact ones."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "label", "terms"))), lambda h: h["terms"])
    known = F.array(*[F.lit(t) for t in exact]) if exact else F.array().cast("array<string>")
    return hits.agg(F.array_except(F.array_distinct(F.flatten(ordered)), known).alias("expanded"))


def rank_for_eval(items: DataFrame, queries: DataFrame, dense_only: bool = False) -> DataFrame:
    """query, id, score, rank of every item for every query of a small, stated set (broadcast below a size the caller knows).

    ``items``: id, image, caption, search_text. ``queries``: query, query_vec, terms. Ties go to the smaller id.
    """
    return ranking.ranked(_scored_for_eval(items, queries, dense_only), ["query"], [F.desc("score"), F.asc("id")])


def _scored_for_eval(items: DataFrame, queries: DataFrame, dense_only: bool) -> DataFrame:
    pairs = items.join(F.broadcast(queries), F.lit(True))
    score = vectors.hybrid_score("query_vec", "image", "caption") + (F.lit(0.0) if dense_only else term_score("search_text", "terms"))
    return pairs.select("query", "id", score.alias("score"))


def ranks_of(items: DataFrame, queries: DataFrame, expected: DataFrame, dense_only: bool = False) -> DataFrame:
    """query, id, rank of the one expected item (query, id) of each query, as rank_for_eval() has it; null where it is missing.

    Only the expected items' scores are looked up; who is above them is counted where the items are, so nothing is sorted.
    """
    scored = _scored_for_eval(items, queries, dense_only)
    own = scored.join(F.broadcast(expected.select("query", "id")), ["query", "id"])
    own = tables.written(own.select("query", F.col("id").alias("_id"), F.col("score").alias("_score")), "expected")
    above = (F.col("score") > F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("id") < F.col("_id")))
    counted = scored.join(F.broadcast(own), "query").groupBy("query").agg((F.count_if(above) + 1).alias("rank"))
    return expected.select("query", "id").join(counted, "query", "left")
