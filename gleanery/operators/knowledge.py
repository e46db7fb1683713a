"""Knowledge of a library (vocabulary, anchors, taught heads, associations), scoring items against all of it by blocks, and retagging what it changes.

The model may be large: a taught label brings up to thousands of example vectors. It is cut into parts of about ``PART_BYTES`` by label; a part is collected and broadcast, and
tasks multiply Arrow batches of items with it as matrices. A row carries its best prompts and taught labels from part to part, so items are neither shuffled
nor compared row by row, and no row holds a label's examples. After ``CHAIN`` parts the rows are written, so an executor holds few parts at once.

A retag computes rows whose inputs or whose knowledge changed and returns those whose tags or terms come out different. Each row's state says what it was computed from
(a hash of its inputs), which labels it matched, and by which version of the knowledge; each version's digests by label are kept. A changed label
concerns rows that matched it, rows that match it now, and rows that show its words; a changed anchor or mean concerns all.

Items without a vector keep their tags. Null tags, terms and writing are empty. Labels without a vector, and vectors of another length than the model's, match nothing. Items are told apart by id; of repeated ids each row is judged.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import hashing, text
from gleanery.functions import tags as T
from gleanery.operators import learn, ranking
from gleanery.sources import tables

#: Bytes of a part's vectors (a part ends with the label that passes them), and parts before rows are written.
PART_BYTES, CHAIN = 32_000_000, 4
#: Tags that the machine may add, from the image and in all.
CAP_SEEN, CAP_ALL = 4, 6
#: Places of a score: the last bits of a matrix product hang on the batch that a row is in.
DIGITS = 9
KEPT = ("vision", "manual", "exemplar", "propagated")
BEST = "array<struct<score:double,label:string,category:string>>"


@dataclass(frozen=True)
class Knowledge:
    """labels: label, category, vector. anchors: vector. heads: label, category, weights, bias, threshold, knn_mean, knn_std. examples: label, positive, vector. associations: label, terms."""

    labels: DataFrame
    anchors: DataFrame
    heads: DataFrame
    examples: DataFrame
    associations: DataFrame
    mean: tuple[float, ...] | None = None


def vocabulary(labels: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a vocabulary (label, category, prompt) has and lacks in a cache (key, model, vector): ready (label, category, vector), missing (key, label, prompt), and the cache without this model's unused keys.

    A key holds a hash of the prompt, so an edited prompt is missing and its old vector unused. Keys of other kinds than labels' stay.
    """
    keyed = labels.withColumn("key", label_key(F.col("label"), F.col("prompt")))
    own = cache.filter(F.col("model") == model)
    ready = keyed.join(own.select("key", "vector"), "key").select("label", "category", "vector")
    missing = keyed.join(own.select("key"), "key", "left_anti").select("key", "label", "prompt")
    unused = own.filter(F.startswith("key", F.lit("label:"))).join(keyed.select("key"), "key", "left_anti").select("key", "model")
    return ready, missing, cache.join(unused, ["key", "model"], "left_anti").select(cache.columns)


def label_key(label: Column, prompt: Column) -> Column:
    return F.concat(F.lit("label:"), hashing.fnv_text(prompt), F.lit(":"), label)


def associations(curated: DataFrame, taught: DataFrame) -> DataFrame:
    """label and its terms, each once: curated ones (label, terms), then those taught with exemplars (id, label, associations)."""
    rows = curated.select("label", F.lit(-1).cast("long").alias("_id"), F.posexplode("terms").alias("_p", "_t")).unionByName(taught.select("label", F.col("id").cast("long").alias("_id"), F.posexplode("associations").alias("_p", "_t")))
    one = rows.groupBy("label", "_t").agg(F.min(F.struct("_id", "_p")).alias("_at"))
    return one.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_t"))), lambda x: x["_t"]).alias("terms"))


@dataclass
class Part:
    """Arrays of some labels. ``spans`` are the places of each head's examples among ``examples`` (positives, then corrections)."""

    prompts: np.ndarray
    prompt_names: list[tuple[str, str]]
    anchors: np.ndarray
    weights: np.ndarray
    head_names: list[tuple[str, str]]
    bias: np.ndarray
    threshold: np.ndarray
    knn: np.ndarray
    examples: np.ndarray
    spans: np.ndarray
    mean: np.ndarray


def _matrix(vectors: list, width: int) -> np.ndarray:
    return np.array(vectors, dtype=np.float64).reshape(-1, width)


def model_parts(k: Knowledge, part_bytes: int = PART_BYTES) -> Iterator[Part]:
    """The model label by label in order of their names; the driver holds one part at a time. A model without vectors has no parts."""
    anchors = [r[0] for r in k.anchors.filter("vector is not null").select("vector").collect()]
    size = lambda df, weight: df.select("label", (weight * F.lit(8)).alias("bytes"))
    sizes = size(k.labels.filter("vector is not null"), F.size("vector")).unionByName(size(k.heads, F.size("weights"))).unionByName(size(k.examples, F.size("vector")))
    placed = ranking.running_total(sizes.groupBy("label").agg(F.sum("bytes").cast("long").alias("bytes")), [], [F.col("label")], F.col("bytes"), "before")
    placed = tables.written(placed.select("label", F.floor(F.col("before") / part_bytes).alias("part")), "model_parts")
    for (number,) in sorted(placed.select("part").distinct().collect()):
        own = placed.filter(F.col("part") == number).select("label")
        prompts = sorted((r.label, r.category or "", r.vector) for r in k.labels.filter("vector is not null").join(own, "label").select("label", "category", "vector").collect())
        heads = sorted(k.heads.join(own, "label").select("label", "category", "weights", "bias", "threshold", "knn_mean", "knn_std").collect())
        shown = sorted((r.label, not r.positive, r.vector) for r in k.examples.join(own, "label").select("label", "positive", "vector").collect())
        width = len((prompts and prompts[0][2]) or (heads and heads[0].weights) or (anchors and anchors[0]) or [])
        prompts, heads = [p for p in prompts if len(p[2]) == width], [h for h in heads if len(h.weights) == width]
        shown = [s for s in shown if len(s[2]) == width]
        keys = [s[:2] for s in shown]
        spans = [[bisect_left(keys, (h.label, False)), bisect_left(keys, (h.label, True)), bisect_right(keys, (h.label, True))] for h in heads]
        knn = [[h.knn_mean if h.knn_mean is not None else 0.0, h.knn_std or 0.0] for h in heads]
        mean = np.asarray(k.mean, dtype=np.float64) if k.mean is not None else np.zeros(width)
        yield Part(
            _matrix([p[2] for p in prompts], width), [p[:2] for p in prompts], _matrix([a for a in anchors if len(a) == width], width), _matrix([h.weights for h in heads], width), [(h.label, h.category or "") for h in heads],
            np.array([h.bias for h in heads]), np.array([h.threshold for h in heads]), np.array(knn).reshape(-1, 2), _matrix([s[2] for s in shown], width), np.array(spans, dtype=np.int64).reshape(-1, 3), mean,
        )


def _largest(sims: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The largest of columns first to last (not included) for each row and span; -1 for an empty span."""
    out = np.full((len(sims), len(first)), -1.0)
    for j, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
        if a < b:
            out[:, j] = sims[:, a:b].max(axis=1)
    return out


def prompt_scores(x: np.ndarray, part: Part) -> np.ndarray:
    """Confidence of each prompt for each row of ``x``; NaN below the margin."""
    bias = learn.ANCHOR_BIAS * (x @ part.anchors.T).max(axis=1, keepdims=True) if len(part.anchors) else 0.0
    margin = x @ part.prompts.T - bias
    at, value = zip(*T.CALIBRATION)
    score = np.interp(margin, at, value)
    score[margin <= at[0]], score[margin > at[-1]] = T.LEAST_CONFIDENCE, T.MOST_CONFIDENCE
    score[margin < learn.MARGIN] = np.nan
    return score


def head_scores(x: np.ndarray, part: Part) -> np.ndarray:
    """Probability of each taught label for each row of ``x``; NaN where neither the head nor the nearest examples match."""
    z = np.clip((x - part.mean) @ part.weights.T + part.bias, -30, 30)
    score = 1 / (1 + np.exp(-z))
    matched = score >= part.threshold
    sims = x @ part.examples.T
    near, against = _largest(sims, part.spans[:, 0], part.spans[:, 1]), _largest(sims, part.spans[:, 1], part.spans[:, 2])
    mean, std = part.knn[:, 0], part.knn[:, 1]
    able = (std > 0) & (part.spans[:, 0] < part.spans[:, 1])
    far = (near - mean) / np.where(std > 0, std, 1.0)
    clear = able & (near > against) & (near >= learn.KNN_COSINE) & (far >= learn.KNN_Z)
    by_example = 1 / (1 + np.exp(-(far - learn.KNN_Z + 0.5)))
    score = np.where(clear, np.maximum(score, by_example), score)
    return np.where(matched | clear, score, np.nan)


def _running(column: pa.Array, scores: np.ndarray, rows: np.ndarray, names: list[tuple[str, str]], top: int) -> list[list[dict]]:
    """Each row's best so far and of this part: by score, then label, one a label."""
    best = [list(v or []) for v in column.to_pylist()]
    touched = set()
    for r, j in zip(*(a.tolist() for a in np.nonzero(~np.isnan(scores)))):
        row = int(rows[r])
        touched.add(row)
        best[row].append({"score": round(float(scores[r, j]), DIGITS), "label": names[j][0], "category": names[j][1]})
    for row in touched:
        kept: dict[str, dict] = {}
        for one in sorted(best[row], key=lambda b: (-b["score"], b["label"])):
            kept.setdefault(one["label"], one)
        best[row] = list(kept.values())[:top]
    return best


def scored(items: DataFrame, k: Knowledge, top: int = learn.TOP, part_bytes: int = PART_BYTES, chain: int = CHAIN) -> DataFrame:
    """``items`` with ``prompts`` and ``taught``: up to ``top`` of each kind that match the item's ``embedding``, best first."""
    out = items.withColumns({"prompts": F.array().cast(BEST), "taught": F.array().cast(BEST)})
    kind = pa.list_(pa.struct([("score", pa.float64()), ("label", pa.string()), ("category", pa.string())]))
    for number, part in enumerate(model_parts(k, part_bytes)):
        known = items.sparkSession.sparkContext.broadcast(part)

        def look(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part, names = known.value, batch.schema.names
                vectors = batch.column(names.index("embedding"))
                lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(lengths == part.prompts.shape[1]) if part.prompts.shape[1] else np.zeros(0, np.int64)
                columns = {n: batch.column(i) for i, n in enumerate(names)}
                if len(rows):
                    x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
                    for name, scores, of in (("prompts", prompt_scores(x, part), part.prompt_names), ("taught", head_scores(x, part), part.head_names)):
                        columns[name] = pa.array(_running(columns[name], scores, rows, of, top), kind)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        out = out.mapInArrow(look, out.schema)
        if number % chain == chain - 1:
            out = tables.written(out, "scored")
    return out


def classified(prompts: Column, taught: Column, top: int = learn.TOP) -> Column:
    """Tags of what scored() found: taught labels first, and each label once; then prompts."""
    as_tags = lambda c, source: F.transform(c, lambda t: F.struct(t["label"].alias("label"), t["category"].alias("category"), t["score"].alias("score"), F.lit(source).alias("source")))
    own = F.transform(taught, lambda t: t["label"])
    rest = F.filter(prompts, lambda p: ~F.array_contains(own, p["label"]))
    return F.slice(F.concat(as_tags(taught, "exemplar"), as_tags(rest, "prompt")), 1, top).cast(T.TAGS)


def classify(items: DataFrame, k: Knowledge, top: int = learn.TOP, part_bytes: int = PART_BYTES) -> DataFrame:
    """``items`` with ``seen``: the tags that the item's vector stands for, ``top`` at most."""
    return scored(items, k, top, part_bytes).withColumn("seen", classified(F.col("prompts"), F.col("taught"), top)).drop("prompts", "taught")


def digests(k: Knowledge) -> DataFrame:
    """label, model, words: digests of all that bears on a label's score and of its words; the row without a label is what all labels share. The order of rows bears on nothing."""
    both = lambda *columns: F.xxhash64(*[F.col(c) for c in columns])
    rows = k.labels.select("label", both("category", "vector").alias("h"), F.lit("prompt").alias("of"))
    rows = rows.unionByName(k.heads.select("label", both("category", "weights", "bias", "threshold", "knn_mean", "knn_std").alias("h"), F.lit("head").alias("of")))
    rows = rows.unionByName(k.examples.select("label", both("positive", "vector").alias("h"), F.lit("example").alias("of")))
    rows = rows.unionByName(k.associations.select("label", F.xxhash64(F.array_sort("terms")).alias("h"), F.lit("words").alias("of")))
    shared = k.anchors.select(F.lit(None).cast("string").alias("label"), F.xxhash64("vector").alias("h"), F.lit("anchor").alias("of"))
    spark = k.labels.sparkSession
    mean = spark.range(1).select(F.lit(None).cast("string").alias("label"), F.xxhash64(F.lit(repr(k.mean))).alias("h"), F.lit("mean").alias("of"))
    total = lambda when: F.concat_ws(":", F.count_if(when), F.sum(F.when(when, F.xxhash64("of", "h").cast("decimal(20,0)"))))
    words = F.col("of") == "words"
    return rows.unionByName(shared).unionByName(mean).groupBy("label").agg(total(~words).alias("model"), total(words).alias("words"))


def _inputs() -> Column:
    return F.xxhash64("embedding", "ocr_text", "tags", "extra_terms")


def _plain(items: DataFrame) -> DataFrame:
    tags = F.coalesce(F.col("tags").cast(T.TAGS), F.array().cast(T.TAGS)).alias("tags")
    return items.select("id", "embedding", F.coalesce("ocr_text", F.lit("")).alias("ocr_text"), tags, F.coalesce("extra_terms", F.lit("")).alias("extra_terms"))


def stale(items: DataFrame, k: Knowledge, states: DataFrame, versions: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The items that a retag with this knowledge would compute anew."""
    return _stale(_plain(items), k, digests(k), states, versions, part_bytes)


def retag(items: DataFrame, k: Knowledge, version: int, states: DataFrame | None = None, versions: DataFrame | None = None, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Updates (id, tags, extra_terms) of items whose tags or terms change, the states after them, and the digests of all versions with this one.

    items: id, embedding, ocr_text, tags, extra_terms. ``states`` and ``versions`` are what the last retag returned; without them all items are computed. Tags that
    people or the vision model gave are kept; terms are only added.
    """
    known = tables.written(digests(k).withColumn("version", F.lit(version).cast("long")), "digests")
    items = _plain(items)
    stale = items if states is None or versions is None else _stale(items, k, known, states, versions, part_bytes)
    words = lambda tags: F.transform(tags, lambda t: F.lower(t["label"]))
    done = scored(stale, k, part_bytes=part_bytes)
    matched = F.array_distinct(F.concat(F.transform("prompts", lambda t: t["label"]), F.transform("taught", lambda t: t["label"]))).alias("matched")
    base = T.merge_durable(F.concat(classified(F.col("prompts"), F.col("taught")), T.ocr_tags("ocr_text").cast(T.TAGS)), CAP_SEEN)
    kept = F.filter("tags", lambda t: F.coalesce(t["source"].isin(*KEPT), F.lit(False)))
    there = F.coalesce(F.size("embedding"), F.lit(0)) > 0
    new = done.select("id", "embedding", "ocr_text", "tags", "extra_terms", matched, F.when(there, T.merge_durable(F.concat(base, kept), CAP_ALL)).otherwise(F.col("tags")).alias("_tags"))
    new = tables.written(_with_terms(new, k.associations, words), "retagged")
    updates = new.filter(~F.col("tags").eqNullSafe(F.col("_tags")) | (F.col("extra_terms") != F.col("_terms"))).select("id", F.col("_tags").alias("tags"), F.col("_terms").alias("extra_terms"))
    after = new.select("id", "matched", F.xxhash64("embedding", "ocr_text", F.col("_tags"), F.col("_terms")).alias("inputs"), F.lit(version).cast("long").alias("version"))
    if states is not None:
        rest = states.join(after.select("id"), "id", "left_anti").join(items.select("id").distinct(), "id", "left_semi")
        after = after.unionByName(rest.withColumn("version", F.lit(version).cast("long")))
    history = known if versions is None else versions.filter(F.col("version") != version).unionByName(known)
    return updates, after, history


def _with_terms(rows: DataFrame, known: DataFrame, words) -> DataFrame:
    """``rows`` with ``_terms``: the tags' labels, their associations and pairs of both, after which come the terms that were there."""
    listed = rows.select("id", F.posexplode(F.transform("_tags", lambda t: t["label"])).alias("_p", "label")).join(known, "label").filter(F.size("terms") > 0)
    more = listed.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("_p", "terms"))).alias("_more"))
    joined = rows.join(more, "id", "left")
    own = F.transform("_tags", lambda t: t["label"])
    spread = F.flatten(F.transform(own, lambda name, i: F.concat(F.array(F.lower(name)), F.transform(F.flatten(F.transform(F.filter(F.coalesce("_more", F.array().cast("array<struct<_p:int,terms:array<string>>>")), lambda m: m["_p"] == i), lambda m: m["terms"])), F.lower))))
    terms = F.array_distinct(spread)
    fresh = F.concat_ws(" ", F.concat_ws(" ", terms), text.context_terms(F.lit(""), terms))
    there = F.coalesce(F.size("embedding"), F.lit(0)) > 0
    return joined.withColumn("_terms", F.when(there, text.union_terms(fresh, "extra_terms")).otherwise(F.col("extra_terms"))).drop("_more")


def _stale(items: DataFrame, k: Knowledge, known: DataFrame, states: DataFrame, versions: DataFrame, part_bytes: int) -> DataFrame:
    """The items to compute anew."""
    present = states.select("version").distinct()
    count = present.count()
    now, then = known.select("label", F.col("model").alias("m"), F.col("words").alias("w")), versions.join(present, "version", "left_semi")
    none = lambda c: F.coalesce(c, F.lit("0"))
    met = then.join(now, then.label.eqNullSafe(now.label), "full").select(F.coalesce(then.label, now.label).alias("label"), "version", "model", "words", "m", "w")

    def moved_in(old: str, new: str) -> Column:
        """Whether a version in use knew the label otherwise; a version without it has the digest of nothing."""
        alike = F.count_if(F.col("version").isNotNull() & (none(F.col(old)) == none(F.col(new))))
        lacking = F.lit(count) - F.count("version")
        return alike + F.when(none(F.max(new)) == "0", lacking).otherwise(0) < count

    moved = met.groupBy("label").agg(moved_in("model", "m").alias("by_model"), moved_in("words", "w").alias("by_words"))
    moved = tables.written(moved.filter("by_model or by_words"), "moved")
    own = items.join(states.withColumnRenamed("version", "_v").withColumnsRenamed({"inputs": "_inputs", "matched": "_matched"}), "id", "left")
    if moved.filter("label is null and by_model").limit(1).count():
        return items
    new = own.filter(~F.coalesce(F.col("_inputs") == _inputs(), F.lit(False))).select(items.columns)
    same = own.filter(F.coalesce(F.col("_inputs") == _inputs(), F.lit(False)))
    by_model, by_words = (moved.filter(c).filter("label is not null").select("label") for c in ("by_model", "by_words"))
    touched = same.select("id", F.explode("_matched").alias("label")).join(by_model, "label", "left_semi").select("id")
    shown = same.select("id", F.explode(F.transform("tags", lambda t: t["label"])).alias("label")).join(by_words, "label", "left_semi").select("id")
    only = lambda df: df.join(by_model, "label", "left_semi")
    part = replace(k, labels=only(k.labels), heads=only(k.heads), examples=only(k.examples))
    hits = scored(same.select("id", "embedding"), part, 1, part_bytes).filter(F.size("prompts") + F.size("taught") > 0).select("id")
    ids = tables.written(touched.unionByName(shown).unionByName(hits).distinct(), "stale")
    return new.unionByName(same.join(ids, "id", "left_semi").select(items.columns))
