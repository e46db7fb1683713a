"""Offline evaluation: recall, MRR, MAP, AUC, calibration, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import tags as T
from gleanery.functions import vectors
from gleanery.operators import ranking

#: Edges of the calibration bins, tolerance of the gates.
EDGES = (0.1, 0.25, 0.4, 0.6, 0.8, 1.01)
TOLERANCE = 0.01


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def retrieval(ranks: DataFrame, cuts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: queries, recall_at_k and mrr from ``rank`` (null if the expected item is missing); zeros for an empty set."""
    recalls = [zero(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)))).alias(f"recall_at_{k}") for k in cuts]
    return ranks.agg(F.count("*").alias("queries"), *recalls, zero(F.avg(zero(1.0 / F.col("rank")))).alias("mrr"))


def average_precision(ranked: DataFrame) -> DataFrame:
    """query, ap, p5, r10, rr from rows (query, rank, relevant); queries without a relevant item are left out.

    Hits are numbered within a query among its relevant rows only.
    """
    hits = ranked.filter("relevant")
    numbered = hits.withColumn("_hit", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
    return numbered.groupBy("query").agg(
        F.avg(F.col("_hit") / F.col("rank")).alias("ap"), (F.count_if(F.col("rank") <= 5) / 5).alias("p5"), (F.count_if(F.col("rank") <= 10) / F.count("*")).alias("r10"), (1.0 / F.min("rank")).alias("rr")
    )


def aspects(ranked: DataFrame) -> DataFrame:
    return average_precision(ranked).agg(F.count("*").alias("queries"), zero(F.avg("ap")).alias("map"), zero(F.avg("p5")).alias("p5"), zero(F.avg("r10")).alias("r10"), zero(F.avg("rr")).alias("mrr"))


def auc(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from (score, correct), ties counted half; null if one side is empty.

    Counts per distinct score come first; they are then added up over ranges of scores.
    """
    by = by or []
    tied = scores.groupBy(*by, "score").agg(F.count_if(F.col("correct")).alias("p"), F.count_if(~F.col("correct")).alias("n"))
    parts = ranking.running_total(tied, by, [F.asc("score")], F.col("n"), "_below")
    area = F.sum(F.col("p") * (F.col("_below") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))
    return parts.groupBy(*by).agg(area.alias("auc")) if by else parts.agg(area.alias("auc"))


def calibration(predictions: DataFrame, edges: tuple[float, ...] = EDGES) -> DataFrame:
    """bin, low, high, n, mean_score, accuracy of the half-open bins, empty ones left out."""
    index = sum(((F.col("score") >= e).cast("int") for e in edges), F.lit(0))
    rows = predictions.withColumn("bin", index).filter(F.col("bin").between(1, len(edges) - 1))
    bounds = F.array(*[F.lit(e) for e in edges])
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("correct").cast("double")).alias("accuracy")).select("bin", F.get(bounds, F.col("bin") - 1).alias("low"), F.get(bounds, F.col("bin")).alias("high"), "n", "mean_score", "accuracy")


def rule_metrics(images: DataFrame) -> DataFrame:
    """Coverage, top-1 precision, tag precision, right and wrong from (id, predictions: array<struct<score, correct>>, best first)."""
    n, top = F.size("predictions"), F.get("predictions", 0)["correct"]
    right = F.size(F.filter("predictions", lambda p: p["correct"]))
    return images.agg(
        F.count("*").alias("images"), zero(F.avg((n > 0).cast("double"))).alias("coverage"), zero(F.avg(F.when(n > 0, top.cast("double")))).alias("top1_precision"),
        zero(F.sum(right) / F.nullif(F.sum(n), F.lit(0))).alias("tag_precision"), F.coalesce(F.sum(right), F.lit(0)).alias("right"), F.coalesce(F.sum(n - right), F.lit(0)).alias("wrong"),
    )


def tier_table(images: DataFrame) -> DataFrame:
    """tier, n, share, precision from (confidence, correct): always the three tiers."""
    tier = F.when(F.col("confidence") >= T.RECOGNIZED, "recognized").when(F.col("confidence") > 0, "weak").otherwise("unknown")
    names = images.sparkSession.createDataFrame([(t,) for t in ("recognized", "weak", "unknown")], "tier string")
    counted = images.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("precision"))
    total = F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0))
    return names.join(counted, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"), "precision").withColumn("share", zero(F.col("n") / total))


def gate(baseline: DataFrame, candidate: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """metric, before, after of the numeric columns that fell by more than ``tolerance``; both have one row."""
    names = [c for c, t in baseline.dtypes if t == "double" and c in candidate.columns]
    flat = lambda df, out: df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names]))).alias("metric", out))
    return flat(baseline, "before").join(flat(candidate, "after"), "metric").filter(F.col("after") < F.col("before") - tolerance)


def word_overlap(label: Column, truth: Column) -> Column:
    """True if a label shares a word with any truth term."""
    parts = lambda t: F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda w: w != "")
    return F.arrays_overlap(parts(label), F.flatten(F.transform(truth, parts)))


def tagging(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Share of must-find terms that some predicted tag holds, over all cases; missing predictions find nothing."""
    joined = cases.join(predictions, "id", "left")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    found = F.size(F.filter("must_find", lambda m: F.exists(tags, lambda t: F.contains(F.lower(t), F.lower(m)))))
    return joined.agg(F.count("*").alias("cases"), zero(F.sum(found) / F.nullif(F.sum(F.size("must_find")), F.lit(0))).alias("must_find_rate"), F.count_if(F.col("tags").isNull()).alias("missing"))


def agreement(items: DataFrame) -> DataFrame:
    """label, asserted, agreed: how often a label the user asserted (source manual) is also in the caption or another tag of the item."""
    own = items.select("caption", "tags", F.explode(F.filter("tags", lambda t: t["source"] == "manual")).alias("a"))
    label = F.lower("a.label")
    other = F.exists("tags", lambda t: (F.coalesce(t["source"], F.lit("")) != "manual") & F.contains(F.lower(t["label"]), label))
    said = F.contains(F.lower(F.coalesce("caption", F.lit(""))), label)
    return own.groupBy(label.alias("label")).agg(F.count("*").alias("asserted"), F.count_if(other | said).alias("agreed"))


def agreement_rows(tagged: DataFrame) -> DataFrame:
    """agreement() of a row for each tag (owner, label, source), without captions. An owner's distinct labels meet in a join, so tags of one label cost nothing more."""
    tags = tagged.select("owner", F.lower("label").alias("label"), (F.coalesce("source", F.lit("")) == "manual").alias("_own"))
    own = tags.filter("_own").groupBy("owner", "label").agg(F.count("*").alias("_n"))
    others = tags.filter("not _own").select(F.col("owner").alias("_o"), F.col("label").alias("_l")).distinct()
    said = own.join(others, F.col("owner").eqNullSafe(F.col("_o")) & F.contains("_l", "label"), "left_semi")
    both = own.select("label", F.col("_n").alias("_a"), F.lit(0).cast("long").alias("_s")).unionByName(said.select("label", F.lit(0).cast("long").alias("_a"), F.col("_n").alias("_s")))
    return both.groupBy("label").agg(F.sum("_a").alias("asserted"), F.sum("_s").alias("agreed"))


def predictions(images: DataFrame, labels: DataFrame, anchors: list[list[float]], rule: str = "margin", top: int = 3, least: float = 0.13, temperature: float = 50.0) -> DataFrame:
    """id, predictions (label, score, correct; best first) by the margin rule, or by a softmax over labels and anchors that keeps labels above every anchor.

    ``images``: id, vector, truth (terms). ``labels`` (label, terms, vector) is a vocabulary of bounded size, broadcast.
    """
    listed = F.array(*[F.array(*[F.lit(float(x)) for x in a]) for a in anchors]) if anchors else F.array().cast("array<array<double>>")
    near = F.transform(listed, lambda a: vectors.dot("vector", a))
    pairs = images.withColumn("_a", near).join(F.broadcast(labels.select("label", "terms", F.col("vector").alias("_v"))), F.lit(True))
    cosine = vectors.dot("vector", "_v")
    scored = pairs.select("id", "label", cosine.alias("_c"), "_a", word_overlap_any("terms", "truth").alias("correct"))
    if rule == "margin":
        margin = F.col("_c") - F.when(F.size("_a") > 0, 0.5 * F.array_max("_a")).otherwise(0.0)
        kept = scored.withColumn("_m", margin).filter(F.col("_m") >= least).withColumn("score", T.confidence("_m"))
        order = F.col("_m")
    else:
        sums = scored.groupBy("id").agg(F.max("_c").alias("_top"), F.first("_a").alias("_an"))
        best = F.greatest("_top", F.coalesce(F.array_max("_an"), F.lit(-2.0)))
        parts = scored.join(sums.withColumn("_best", best).select("id", "_best"), "id")
        own = F.exp(temperature * (F.col("_c") - F.col("_best")))
        others = F.aggregate(F.transform("_a", lambda a: F.exp(temperature * (a - F.col("_best")))), F.lit(0.0), lambda s, x: s + x)
        total = F.sum(own).over(Window.partitionBy("id")) + others
        kept = parts.withColumn("score", own / total).filter(F.col("_c") > F.coalesce(F.array_max("_a"), F.lit(-2.0)))
        order = F.col("score")
    placed = kept.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(order.desc(), "label"))).filter(F.col("_r") <= top)
    found = placed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "label", "score", "correct"))), lambda p: F.struct(p["label"].alias("label"), p["score"].alias("score"), p["correct"].alias("correct"))).alias("predictions"))
    none = F.array().cast(found.schema["predictions"].dataType)
    return images.select("id").join(found, "id", "left").select("id", F.coalesce("predictions", none).alias("predictions"))


def word_overlap_any(a: str, b: str) -> Column:
    """True if two lists of terms share a word."""
    parts = lambda c: F.flatten(F.transform(F.col(c), lambda t: F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda w: w != "")))
    return F.arrays_overlap(parts(a), parts(b))


def signals(items: DataFrame, labels: DataFrame, anchors: list[list[float]], sharpness: float = 50.0) -> DataFrame:
    """id, label (the nearest; of equals the least), signal, score: five measures of how sure the nearest label is.

    ``biased`` and ``anchored`` take half and all of the nearest anchor off the cosine, ``softmax`` is its share over labels and anchors, ``gap`` its lead over the second.
    ``labels`` (label, vector) is a vocabulary of bounded size; anchors are literals.
    """
    listed = [F.array(*[F.lit(float(x)) for x in a]) for a in anchors]
    own = items.select("id", "embedding", F.array(*[vectors.cosine("embedding", a) for a in listed]).cast("array<double>").alias("_a"))
    pairs = own.join(F.broadcast(labels), F.lit(True)).select("id", "_a", F.struct((-vectors.cosine("embedding", "vector")).alias("c"), "label").alias("_s"))
    near = pairs.groupBy("id").agg(F.first("_a").alias("_a"), F.sort_array(F.collect_list("_s")).alias("_s"))
    anchor, top = F.coalesce(F.array_max("_a"), F.lit(0.0)), -F.col("_s")[0]["c"]
    every = F.concat(F.transform("_s", lambda s: -s["c"]), "_a")
    most = F.array_max(every)
    total = F.aggregate(F.transform(every, lambda c: F.exp(sharpness * (c - F.col("_m")))), F.lit(0.0), lambda a, x: a + x)
    told = near.withColumn("_m", most).select("id", F.col("_s")[0]["label"].alias("label"), F.explode(F.create_map(
        F.lit("biased"), top - 0.5 * anchor, F.lit("cosine"), top, F.lit("anchored"), top - anchor, F.lit("softmax"), F.exp(sharpness * (top - F.col("_m"))) / total, F.lit("gap"), top + F.coalesce(F.get("_s", F.lit(1))["c"], F.lit(0.0)),
    )).alias("signal", "score"))
    return told
