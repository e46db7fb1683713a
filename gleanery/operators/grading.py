"""Grades of a tagger and the sets they are taken on: agreement with people's labels, cases with terms to be found and facets to be covered, zero-shot ranks, and aspects for search.

Item lists come as rows, so a label that a third of all items miss is a third of the rows, not one list. Items without tags count where a grade says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators import evaluate
from gleanery.sources import tables

#: Sources of tags that people stand for.
PEOPLE = ("manual", "exemplar")
#: Lengths and words of a tag that makes an aspect, items it must be on, aspects in all.
TAG_CHARS, TAG_WORDS, ASPECT_ITEMS, ASPECTS = (3, 40), 5, 3, 80
#: Label vectors that are broadcast at a time.
LABEL_ROWS = 4096


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


# Agreement with people's labels


def assertions(items: DataFrame) -> DataFrame:
    """id, label, agreed of each label that people stand for on an item, once an item: whether the model's own tags and caption hold it; null where the model said nothing.

    items: id, caption, tags (label, source).
    """
    said = F.filter("tags", lambda t: F.coalesce(t["source"] == "vision", F.lit(False)))
    hay = plain(F.concat_ws(" ", F.array_join(F.transform(said, lambda t: t["label"]), " "), F.coalesce("caption", F.lit(""))))
    own = F.filter("tags", lambda t: F.coalesce(t["source"].isin(*PEOPLE), F.lit(False)))
    labels = F.array_distinct(F.filter(F.transform(own, lambda t: plain(t["label"])), lambda x: x != ""))
    rows = items.select("id", hay.alias("_hay"), F.explode(labels).alias("label"))
    return rows.select("id", "label", F.when(F.col("_hay") != "", F.contains("_hay", "label")).alias("agreed"))


def label_agreement(asserted: DataFrame) -> DataFrame:
    """label, asserted, agreed, of assertions() that the model could have met."""
    return asserted.filter("agreed is not null").groupBy("label").agg(F.count("*").alias("asserted"), F.count_if("agreed").alias("agreed"))


def missed(asserted: DataFrame) -> DataFrame:
    """label and id of each assertion that the model missed."""
    return asserted.filter("not agreed").select("label", "id")


def agreement_summary(asserted: DataFrame) -> DataFrame:
    """One row: items with people's labels, those of them that the model left undescribed, assertions, agreed, and their rate (0 without any)."""
    by_item = asserted.groupBy("id").agg(F.count("agreed").alias("_n"), F.count_if("agreed").alias("_a"))
    sums = by_item.agg(F.count("*").alias("with_truth"), F.count_if(F.col("_n") == 0).alias("undescribed"), F.coalesce(F.sum("_n"), F.lit(0)).alias("assertions"), F.coalesce(F.sum("_a"), F.lit(0)).alias("agreed"))
    return sums.withColumn("rate", evaluate.zero(F.try_divide("agreed", "assertions")))


# Cases


def graded_cases(cases: DataFrame, predictions: DataFrame, tag_facets: DataFrame) -> DataFrame:
    """id, has_prediction, found, matched_terms, missing_facets of cases (id, must_find, expect_facets) by predictions (id, tags) and the facets (label, facet) of tags.

    A term is found if it is in the tags' text, one after the other with a blank between, whatever its case.
    """
    none = F.array().cast("array<string>")
    covered = predictions.select("id", F.explode("tags").alias("label")).join(tag_facets.select("label", "facet").distinct(), "label").groupBy("id").agg(F.collect_set("facet").alias("_facets"))
    joined = cases.join(predictions.select("id", "tags"), "id", "left").join(covered, "id", "left").withColumn("_hay", F.lower(F.array_join("tags", " ")))
    terms = F.when(F.col("tags").isNotNull(), F.filter("must_find", lambda t: F.contains(F.col("_hay"), F.lower(t)))).otherwise(none)
    lacking = F.array_except(F.coalesce("expect_facets", none), F.coalesce("_facets", none))
    return joined.select("id", F.col("tags").isNotNull().alias("has_prediction"), terms.alias("matched_terms"), lacking.alias("missing_facets"), F.size(F.array_distinct(F.coalesce("expect_facets", none))).alias("_expected")).withColumn("found", F.size("matched_terms") > 0)


def case_summary(graded: DataFrame) -> DataFrame:
    """One row: cases, the share that some term finds, and the share of expected facets that are covered (1 if none is expected)."""
    facets = F.try_divide(F.sum(F.col("_expected") - F.size("missing_facets")), F.sum("_expected"))
    return graded.agg(F.count("*").alias("n"), evaluate.zero(F.avg(F.col("found").cast("double"))).alias("must_find_rate"), F.coalesce(facets, F.lit(1.0)).alias("facet_recall"))


# Zero-shot ranks


def label_ranks(items: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS) -> DataFrame:
    """id and rank of each item's ``label`` among all labels by inner product; of equal ones the earlier label (by ``position``) is ahead. Null where the label isn't there.

    items: id, vector, label. labels: label, position, vector, one row a label. Labels are broadcast LABEL_ROWS at a time and multiplied with batches of items as matrices; a row carries its count of better labels on.
    """
    own = labels.select("label", F.col("position").cast("long").alias("_at"), F.col("vector").alias("_own"))
    rows = items.select("id", "vector", "label").join(own, "label", "left").withColumn("_ahead", F.lit(0).cast("long"))
    numbered = tables.written(labels.select("label", F.col("position").cast("long").alias("position"), F.col("vector").cast("array<double>").alias("vector")).withColumn("_part", F.pmod(F.xxhash64("label"), F.lit(max(1, -(-labels.count() // label_rows))))), "labels")
    for (part,) in sorted(numbered.select("_part").distinct().collect()):
        found = numbered.filter(F.col("_part") == part).collect()
        width = max((len(r.vector) for r in found), default=0)
        found = [r for r in found if len(r.vector) == width]
        known = items.sparkSession.sparkContext.broadcast((np.array([r.vector for r in found]).reshape(-1, width), np.array([r.position for r in found]), np.array([r.label for r in found], dtype=object)))

        def count(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            matrix, position, names = known.value
            for batch in batches:
                columns = dict(zip(batch.schema.names, batch.columns))
                fits = [pc.equal(pc.fill_null(pc.list_value_length(columns[c]), 0), matrix.shape[1]).to_numpy(zero_copy_only=False) for c in ("vector", "_own")]
                rows = np.flatnonzero(fits[0] & fits[1])
                ahead = columns["_ahead"].to_numpy(zero_copy_only=False).copy()
                if len(rows):
                    x, y = (columns[c].take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1) for c in ("vector", "_own"))
                    mine, at, name = np.einsum("nd,nd->n", x, y)[:, None], columns["_at"].take(pa.array(rows)).to_numpy(zero_copy_only=False)[:, None], np.array(columns["label"].take(pa.array(rows)).to_pylist(), dtype=object)[:, None]
                    scores = x @ matrix.T
                    # products that differ in their last bits alone are equal
                    near = np.abs(scores - mine) <= 1e-12 * (1 + np.abs(mine))
                    ahead[rows] += (((scores > mine) & ~near) | (near & (position[None, :] < at) & (names[None, :] != name))).sum(axis=1)
                columns["_ahead"] = pa.array(ahead, pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        rows = rows.mapInArrow(count, rows.schema)
    return rows.select("id", F.when(F.col("_own").isNotNull(), F.col("_ahead") + 1).alias("rank"))


def zero_shot(items: DataFrame, queries: DataFrame, label_rows: int = LABEL_ROWS) -> DataFrame:
    """One row: n, labels, recall_at_1, 3 and 5, mrr of tagging items (id, vector) with the texts of queries (number, query, vector, expected_id) as labels.

    A label's vector is that of its first query; an item's label that of the last query that expects it. Items that none expects are left out.
    """
    labels = queries.groupBy("query").agg(F.min_by("vector", "number").alias("vector"), F.min("number").alias("position")).withColumnRenamed("query", "label")
    truth = queries.groupBy(F.col("expected_id").alias("id")).agg(F.max_by("query", "number").alias("label"))
    ranks = label_ranks(items.select("id", "vector").join(truth, "id"), labels, label_rows)
    return evaluate.retrieval(ranks, (1, 3, 5)).withColumnRenamed("queries", "n").join(labels.agg(F.count("*").alias("labels")))


# Golden sets


def golden_tag(tag: Column) -> Column:
    """A tag as an aspect: lower case, blanks for hyphens and underscores; null if it is too short, too long or a sentence."""
    t = F.trim(F.regexp_replace(F.lower(F.translate(tag, "-_", "  ")), r"\s+", " "))
    return F.when(F.length(t).between(*TAG_CHARS) & (F.size(F.split(t, " ")) <= TAG_WORDS), t)


def golden_aspects(tags: DataFrame, least: int = ASPECT_ITEMS, most: int | None = ASPECTS) -> tuple[DataFrame, DataFrame]:
    """Aspects (tag, n): tags on at least ``least`` items, the ``most`` commonest (of equals the first by name); and the items (tag, id) that each is on. tags: id, tag."""
    own = tags.select("id", golden_tag(F.col("tag")).alias("tag")).filter("tag is not null").distinct()
    common = own.groupBy("tag").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    kept = common if most is None else common.orderBy(F.desc("n"), "tag").limit(most)
    return kept, own.join(kept.select("tag"), "tag", "left_semi")
