"""Classification: zero-shot by label vectors with anchors, and logistic heads from a few examples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import tags as T
from gleanery.functions import vectors

#: The anchors' share, the least margin, labels kept.
ANCHOR_BIAS, MARGIN, TOP = 0.5, 0.13, 3
#: Fit of a head.
ITERATIONS, RATE, L2, STOP = 250, 0.5, 5e-3, 1e-4
#: Background too near a positive; hard negatives; bounds of the threshold; kNN.
PU_COSINE, HARD_COSINE, LOW, HIGH, ABOVE = 0.85, 0.65, 0.6, 0.92, 0.05
KNN_COSINE, KNN_Z, KNN_BACKGROUND = 0.88, 3.0, 8
MANUAL_CAP = 16
#: Examples of a label, and other labels' positives, that a head is fitted on.
EXAMPLES = 5000


def zero_shot(items: DataFrame, labels: DataFrame, anchors: list[list[float]], margin: float = MARGIN, top: int | None = TOP) -> DataFrame:
    """id, label, margin, confidence, rank: labels whose similarity less half the nearest anchor's reaches ``margin``.

    ``labels`` (label, vector) is a vocabulary of bounded size (a few hundred); anchors are literals.
    """
    listed = F.array(*[F.array(*[F.lit(float(x)) for x in a]) for a in anchors]) if anchors else F.array().cast("array<array<double>>")
    biased = items.select("id", "embedding", F.when(F.size(listed) > 0, ANCHOR_BIAS * vectors.max_cosine("embedding", listed)).otherwise(0.0).alias("_bias"))
    pairs = biased.join(F.broadcast(labels), F.lit(True))
    scored = pairs.select("id", "label", (vectors.dot("embedding", "vector") - F.col("_bias")).alias("margin")).filter(F.col("margin") >= margin)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("margin"), "label")))
    return (ranked if top is None else ranked.filter(F.col("rank") <= top)).withColumn("confidence", T.confidence("margin"))


def fit_logistic(positive: np.ndarray, negative: np.ndarray, iterations: int = ITERATIONS, rate: float = RATE, l2: float = L2) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent with balanced classes; weights are kept as 32-bit floats, the bias isn't penalised."""
    x = np.concatenate([positive, negative]).astype(np.float64)
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))])
    weight = np.concatenate([np.full(len(part), 0.5 / max(1, len(part))) for part in (positive, negative)])
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    for _ in range(iterations):
        error = (1 / (1 + np.exp(-np.clip(x @ w.astype(np.float64) + b, -30, 30))) - y) * weight
        gradient, bias = x.T @ error + l2 * w.astype(np.float64), error.sum()
        w, b = (w - rate * gradient).astype(np.float32), b - rate * bias
        if rate * max(np.abs(gradient).max(), abs(bias)) < STOP:
            break
    return w, float(b)


def training_set(positive: np.ndarray, negative: np.ndarray, background: np.ndarray, others: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Negatives of a head (centred), the background kept among them, and how near each kept background vector is to a positive.

    Background and other labels' positives that are nearly a positive go; hard background counts twice; corrections count once for 25 kept background rows.
    """
    nearest = lambda x: (x @ positive.T).max(1) if len(x) else np.zeros(0)
    near = nearest(background)
    near, kept = near[near < PU_COSINE], background[near < PU_COSINE] - mean
    kept = np.repeat(kept, np.where(near >= HARD_COSINE, 2, 1), axis=0)
    apart = others[nearest(others) < PU_COSINE] - mean
    times = max(1, int(len(kept) / 25 + 0.5))
    return np.concatenate([kept, apart, np.repeat(negative - mean, times, axis=0)]), kept, near


def train_heads(examples: DataFrame, background: np.ndarray, mean: np.ndarray | None = None, most: int = EXAMPLES) -> DataFrame:
    """label, weights, bias, threshold, knn_mean, knn_std, positives, negatives from examples (label, vector, positive).

    Heads work on vectors less ``mean`` (of the library; zero if not given), nearness on the vectors as they are. One group a label; a head is fitted on at most ``most`` examples
    of its label and ``most`` other labels' positives (the first by a hash). The background is a bounded sample; both are broadcast.
    """
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("vector", "positive"), "vector"))
    own = examples.withColumn("_r", place).filter(F.col("_r") <= most).drop("_r")
    rest = own.filter("positive").orderBy(F.xxhash64("label", "vector"), "label", "vector").limit(most).select("label", "vector").collect()
    back = np.asarray(background, dtype=np.float64)
    width = back.shape[1] if back.ndim == 2 else len(rest[0]["vector"]) if rest else 0
    centre = np.zeros(width) if mean is None else np.asarray(mean, dtype=np.float64)
    shared = examples.sparkSession.sparkContext.broadcast((back.reshape(-1, width), [r["label"] for r in rest], np.array([r["vector"] for r in rest], dtype=np.float64).reshape(-1, width), centre))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        back, labels, others, centre = shared.value
        label = frame.label.iloc[0]
        pos = np.array(frame.loc[frame.positive, "vector"].tolist(), dtype=np.float64)
        neg = np.array(frame.loc[~frame.positive, "vector"].tolist(), dtype=np.float64).reshape(-1, len(centre))
        if not len(pos):
            return pd.DataFrame({"label": [], "weights": [], "bias": [], "threshold": [], "knn_mean": [], "knn_std": [], "positives": [], "negatives": []})
        against, kept, near = training_set(pos, neg, back, others[[x != label for x in labels]], centre)
        w, b = fit_logistic(pos - centre, against)
        worst = (1 / (1 + np.exp(-np.clip(kept @ w + b, -30, 30)))).max(initial=0)
        enough = len(near) >= KNN_BACKGROUND
        return pd.DataFrame({"label": [label], "weights": [w.tolist()], "bias": [b], "threshold": [min(HIGH, max(LOW, float(worst) + ABOVE))], "knn_mean": [float(near.mean()) if enough else None], "knn_std": [float(near.std()) if enough else None], "positives": [pos.tolist()], "negatives": [neg.tolist()]})

    schema = "label string, weights array<float>, bias double, threshold double, knn_mean double, knn_std double, positives array<array<double>>, negatives array<array<double>>"
    return own.groupBy("label").applyInPandas(fit, schema)


def capped_examples(explicit: DataFrame, manual: DataFrame, cap: int = MANUAL_CAP) -> DataFrame:
    """Explicit examples, and manually tagged ones (label, id, vector) up to ``cap`` positives a label."""
    own = explicit.filter("positive").groupBy("label").agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    more = manual.join(own, "label", "left").withColumn("_p", place).filter(F.col("_p") <= F.lit(cap) - F.coalesce("_n", F.lit(0)))
    return explicit.select("label", "vector", "positive").unionByName(more.select("label", "vector", F.lit(True).alias("positive")))


def score_heads(items: DataFrame, heads: DataFrame, mean: list[float] | None = None) -> DataFrame:
    """id, label, probability, nearest, hit: a head's probability over its threshold, or a clear nearest neighbour. Heads are a small model table."""
    pairs = items.join(F.broadcast(heads), F.lit(True))
    centred = F.col("embedding") if mean is None else F.zip_with("embedding", F.array(*[F.lit(float(x)) for x in mean]), lambda x, m: x - m)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), vectors.dot(centred, "weights") + F.col("bias")))
    near = vectors.max_cosine("embedding", "positives")
    scored = pairs.select("id", "label", (1 / (1 + F.exp(-z))).alias("probability"), near.alias("nearest"), vectors.max_cosine("embedding", "negatives").alias("_neg"), "threshold", "knn_mean", "knn_std")
    knn = (F.col("nearest") > F.col("_neg")) & (F.col("nearest") >= KNN_COSINE) & ((F.col("nearest") - F.col("knn_mean")) / F.nullif(F.col("knn_std"), F.lit(0.0)) >= KNN_Z)
    return scored.select("id", "label", "probability", "nearest", ((F.col("probability") >= F.col("threshold")) | F.coalesce(knn, F.lit(False))).alias("hit"))


def merge_classified(prompts: DataFrame, exemplars: DataFrame, top: int = TOP) -> DataFrame:
    """Up to ``top`` labels an item from (id, label, score): an exemplar's label replaces the prompt's and sorts first."""
    rows = prompts.withColumn("_o", F.lit(1)).unionByName(exemplars.withColumn("_o", F.lit(0)))
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy("id", F.lower("label")).orderBy("_o", F.desc("score")))).filter("_r = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("_o", F.desc("score"), "label"))).filter(F.col("rank") <= top).select("id", "label", "score", "rank")
