"""Similarity: similar items, label propagation, threshold joins, twins, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text, vectors
from gleanery.operators import graph
from gleanery.sources import tables

#: Thresholds of propagation by space, its cap, of clusters, twins and frames.
PROPAGATE_VISUAL, PROPAGATE_PRIMARY, PROPAGATE_CAP = 0.70, 0.88, 40
CLUSTER, TWIN, FRAME = 0.86, 0.99, 0.985
GENERIC_NAMES = ("meme", "funny", "humor", "reaction", "reaction image", "relatable", "template", "meme format", "image", "photo", "screenshot")
#: Rows of a block of the threshold join.
BLOCK = 4096


def similar_items(items: DataFrame, target: list[float], exclude: int | None = None, limit: int = 12) -> DataFrame:
    """The ``limit`` items with the largest product with one vector: a top-k without a full sort."""
    q = F.array(*[F.lit(float(x)) for x in target])
    rows = items if exclude is None else items.filter(F.col("id") != exclude)
    return rows.filter(vectors.present("embedding")).select("id", vectors.dot("embedding", q).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def similarity_pairs(items: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """a < b and score for all pairs of items whose product reaches ``threshold``; exact, and only these pairs leave a task.

    Vectors are packed into blocks sorted by their nearest of a few pivots. A block keeps its centre and radius as angles, so a pair of blocks goes untouched when no two of
    its vectors can be near enough; the rest are multiplied as matrices. Vectors should have length 1; others are handled without this pruning.
    """
    rows = items.filter(vectors.present("embedding")).select("id", F.col("embedding").cast("array<double>").alias("v"))
    n = rows.count()
    blocks = max(1, -(-n // block))
    packed = rows.repartitionByRange(blocks, F.transform("v", F.signum), "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        flat: list[list[float]] = []

        def out() -> pa.RecordBatch:
            x = np.array(flat)
            length = np.linalg.norm(x, axis=1)
            centre = x.mean(0)
            size = np.linalg.norm(centre)
            radius = float(np.arccos(np.clip(x @ centre / size, -1, 1)).max()) if size > 0 and np.allclose(length, 1, atol=1e-6) else 4.0
            return pa.RecordBatch.from_arrays([pa.array([min(ids)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([x.ravel()], pa.list_(pa.float64())), pa.array([(centre / size if size > 0 else centre)], pa.list_(pa.float64())), pa.array([radius])], ["block", "ids", "flat", "centre", "radius"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(ids) >= block:
                    yield out()
                    ids, flat = [], []
                ids.append(i)
                flat.append(v)
        if ids:
            yield out()

    made = tables.written(packed.mapInArrow(pack, "block long, ids array<long>, flat array<double>, centre array<double>, radius double"), "blocks")
    about = lambda side: made.select(*[F.col(c).alias(f"{c}_{side}") for c in ("block", "centre", "radius")])
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vectors.dot("centre_a", "centre_b")))) - F.col("radius_a") - F.col("radius_b")
    # Blocks are told apart by their centres alone; only pairs that remain fetch their vectors.
    near = about("a").join(about("b"), (F.col("block_a") <= F.col("block_b")) & (apart <= float(np.arccos(np.clip(threshold, -1, 1))) + 1e-9)).select("block_a", "block_b")
    full = lambda side: made.select(*[F.col(c).alias(f"{c}_{side}") for c in ("block", "ids", "flat")])
    met = near.join(full("a"), "block_a").join(full("b"), "block_b")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ia, ib = (batch.column(c)[r].values.to_numpy() for c in (0, 1))
                x, y = (batch.column(c)[r].values.to_numpy().reshape(len(i), -1) for c, i in ((2, ia), (3, ib)))
                for s in range(0, len(x), 512):
                    a, b = np.nonzero(x[s : s + 512] @ y.T >= threshold - 1e-9)
                    left, right = ia[s + a], ib[b]
                    score = np.array([sum(p * q for p, q in zip(x[s + i].tolist(), y[j].tolist())) for i, j in zip(a, b)])
                    low, high = np.minimum(left, right), np.maximum(left, right)
                    keep = ((left < right) | (batch.column(4)[r].as_py() & (left != right))) & (score >= threshold) if len(score) else np.zeros(0, bool)
                    yield pa.RecordBatch.from_arrays([pa.array(low[keep]), pa.array(high[keep]), pa.array(score[keep] if len(score) else np.zeros(0))], ["a", "b", "score"])

    return met.select("ids_a", "ids_b", "flat_a", "flat_b", (F.col("block_a") != F.col("block_b")).alias("cross")).mapInArrow(multiply, "a long, b long, score double")


def propagate(sources: DataFrame, candidates: DataFrame, active_model: str, cap: int = PROPAGATE_CAP, visual: float = PROPAGATE_VISUAL, primary: float = PROPAGATE_PRIMARY) -> DataFrame:
    """id, source, space, score, margin of the candidates that a labelled source is near enough to, best margin first.

    ``sources`` is the user's selection, a small stated set. Both have id, embedding, visual_embedding, visual_model; candidates also durable.
    """
    s = sources.select(F.col("id").alias("source"), F.col("embedding").alias("_e"), F.col("visual_embedding").alias("_v"), F.col("visual_model").alias("_m"))
    pairs = candidates.filter(~F.col("durable")).join(F.broadcast(s), F.col("id") != F.col("source"))
    space = vectors.pair_space(F.col("visual_model"), F.col("visual_embedding"), F.col("_m"), F.col("_v"), active_model)
    a, b = F.when(space == "visual", F.col("visual_embedding")).otherwise(F.col("embedding")), F.when(space == "visual", F.col("_v")).otherwise(F.col("_e"))
    fits = vectors.present(a) & (F.size(a) == F.size(b))
    score = F.when(fits, vectors.dot(a, b))
    margin = score - F.when(space == "visual", visual).otherwise(primary)
    scored = pairs.select("id", "source", space.alias("space"), score.alias("score"), margin.alias("margin")).filter("margin >= 0")
    best = scored.groupBy("id").agg(F.max_by(F.struct("source", "space", "score", "margin"), F.struct("margin", -F.col("source"))).alias("b"))
    return best.select("id", "b.*").orderBy(F.desc("margin"), "id").limit(cap)


def twins(items: DataFrame, described: DataFrame, threshold: float = TWIN) -> DataFrame:
    """id, twin, score: for each item the described item of equal normalised text whose vector is nearest, if near enough; of equally near ones the larger id.

    Texts are known by two 64-bit hashes. Rows of one text and vector count as one: of described ones the two largest ids stay, since only an item itself can be passed over, so copies never meet in pairs; different
    vectors of one text do.
    """
    key = ["_t", "_u"]
    hashed = lambda df: df.filter(text.label("ocr_text") != "").select("id", F.xxhash64(text.label("ocr_text")).alias("_t"), F.xxhash64(F.lit(1), text.label("ocr_text")).alias("_u"), F.col("embedding").alias("_v"))
    own, known = hashed(items), hashed(described)
    # the largest id, and the largest of the others
    top = known.groupBy(*key, "_v").agg(F.max("id").alias("_one"))
    other = known.join(top, [*key, "_v"]).filter(F.col("id") < F.col("_one")).groupBy(*key, "_v").agg(F.max("id").alias("_two"))
    right = top.join(other, [*key, "_v"], "left").select(*key, F.col("_v").alias("_b"), F.array_compact(F.array("_one", "_two")).alias("_ids"))
    left = own.select(*key, F.col("_v").alias("_a")).distinct()
    scored = left.join(right, key).withColumn("score", vectors.dot("_a", "_b")).filter(F.col("score") >= threshold)
    best = scored.select(*key, "_a", "score", F.explode("_ids").alias("twin")).groupBy(*key, "_a").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "twin")), asc=False), 1, 2).alias("_best"))
    met = own.join(best.withColumnRenamed("_a", "_v"), [*key, "_v"]).withColumn("_m", F.get(F.filter("_best", lambda x: x["twin"] != F.col("id")), F.lit(0)))
    return met.filter("_m is not null").select("id", "_m.twin", "_m.score")


def clusters(items: DataFrame, threshold: float = CLUSTER, least: int = 2, texts: int = 2) -> DataFrame:
    """cluster (least id), size, distinct_texts, is_template, name of single-linkage clusters.

    ``items``: id, embedding, text, tags (labels). The name is the most frequent label that more than one member has; of equals the shorter, then the first.
    """
    linked = graph.components(similarity_pairs(items, threshold).select("a", "b")).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    members = items.join(linked, "id")
    normal = F.nullif(text.label(F.coalesce("text", F.lit(""))), F.lit(""))
    summary = members.groupBy("cluster").agg(F.count("*").alias("size"), F.count_distinct(normal).alias("distinct_texts")).filter(F.col("size") >= least)
    labels = members.select("cluster", "id", F.explode(F.array_distinct(F.transform("tags", text.label))).alias("label")).filter((F.col("label") != "") & ~F.col("label").isin(*GENERIC_NAMES))
    counted = labels.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
    named = counted.groupBy("cluster").agg(F.min_by("label", F.struct(-F.col("n"), F.length("label"), "first", "label")).alias("name"))
    template = (F.col("distinct_texts") >= texts) | ((F.col("distinct_texts") == 0) & (F.col("size") >= least + 1))
    return summary.join(named, "cluster", "left").select("cluster", "size", "distinct_texts", template.alias("is_template"), F.coalesce("name", F.lit("")).alias("name"))


def distinct_frames(frames: DataFrame, threshold: float = FRAME, most: int = 8) -> DataFrame:
    """Per item, its frames in order without those too near to a kept one, ``most`` at most: a fold over an ordered array, which is short by nature."""
    listed = frames.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "embedding"))).alias("_f"))
    none = F.array().cast(listed.schema["_f"].dataType)
    fold = F.aggregate("_f", none, lambda kept, f: F.when((F.size(kept) >= most) | F.exists(kept, lambda k: vectors.dot(k["embedding"], f["embedding"]) >= threshold), kept).otherwise(F.concat(kept, F.array(f))))
    return listed.select("id", F.explode(fold).alias("f")).select("id", "f.ordinal", "f.embedding")
