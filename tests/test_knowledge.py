import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import tags as T
from gleanery.operators import knowledge as K
from gleanery.operators import merge

RNG = np.random.default_rng(4)
WIDTH = 8


def unit(n):
    x = RNG.normal(size=(n, WIDTH))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


PROMPTS = {f"p{i}": v for i, v in enumerate(unit(12))}
ANCHORS = unit(3)
HEADS = {f"h{i}": (v * 9, -3.0, 0.7, 0.1, 0.2) for i, v in enumerate(unit(6))}
EXAMPLES = [(f"h{i % 6}", i % 4 != 0, v) for i, v in enumerate(unit(40))]
ITEMS = [(i, v) for i, v in enumerate(np.concatenate([unit(60), np.array([v for _, _, v in EXAMPLES[:20]]), np.array(list(PROMPTS.values()))]))]
MEAN = tuple(float(x) for x in np.mean([v for _, v in ITEMS], axis=0))
TERMS = {"p1": ["Wide", "two words"], "h2": ["zeta"], "kept": ["of a manual tag"]}


def knowledge(spark, prompts=PROMPTS, heads=HEADS, examples=EXAMPLES, terms=TERMS, anchors=ANCHORS):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return K.Knowledge(
        frame([(n, "c", v.tolist()) for n, v in prompts.items()], "label string, category string, vector array<double>"), frame([(a.tolist(),) for a in anchors], "vector array<double>"),
        frame([(n, "c", w.tolist(), b, t, m, s) for n, (w, b, t, m, s) in heads.items()], "label string, category string, weights array<double>, bias double, threshold double, knn_mean double, knn_std double"),
        frame([(n, p, v.tolist()) for n, p, v in examples], "label string, positive boolean, vector array<double>"), frame(list(terms.items()), "label string, terms array<string>"), MEAN,
    )


def plainly(v, prompts=PROMPTS, heads=HEADS, top=3):
    """The three best tags, one item and one label at a time."""
    bias = 0.5 * max(float(v @ a) for a in ANCHORS)
    found = []
    for name, p in prompts.items():
        m = float(v @ p) - bias
        if m >= 0.13:
            steps = T.CALIBRATION
            score = 0.9 if m > steps[-1][0] else next(y0 + (m - x0) / (x1 - x0) * (y1 - y0) for (x0, y0), (x1, y1) in zip(steps, steps[1:]) if m <= x1)
            found.append((1, -round(score, 9), name))
    for name, (w, b, threshold, mean, std) in heads.items():
        prob = 1 / (1 + math.exp(-max(-30, min(30, float((v - np.array(MEAN)) @ w) + b))))
        near = max((float(v @ e) for n, p, e in EXAMPLES if n == name and p), default=-1)
        against = max((float(v @ e) for n, p, e in EXAMPLES if n == name and not p), default=-1)
        hit = prob >= threshold
        z = (near - mean) / std
        if near > against and near >= 0.88 and z >= 3:
            hit, prob = True, max(prob, 1 / (1 + math.exp(-(z - 2.5))))
        if hit:
            found.append((0, -round(prob, 9), name))
    return [(n, round(-s, 6)) for _, s, n in sorted(found)[:top]]


def items(spark, rows=ITEMS):
    full = [(i, v.tolist(), None, [("kept", "c", 1.0, "manual"), ("old", "c", 0.5, "prompt")] if i % 3 == 0 else None, "said before" if i % 2 else None) for i, v in rows]
    full += [(900, None, "wagmi", [("old", "c", 0.5, "prompt")], "x"), (901, [], None, None, None), (902, [1.0, 2.0], None, None, None), (903, [None] * WIDTH, None, None, None)]
    return spark.createDataFrame(full, f"id long, embedding array<double>, ocr_text string, tags {T.TAGS}, extra_terms string")


@pytest.mark.parametrize("part_bytes", [K.PART_BYTES, 900])
def test_blocks_equal_one_by_one(spark, part_bytes):
    found = K.scored(items(spark), knowledge(spark), part_bytes=part_bytes, chain=3).withColumn("seen", K.classified(F.col("prompts"), F.col("taught"))).collect()
    got = {r.id: [(t.label, round(t.score, 6)) for t in r.seen] for r in found}
    assert {i: got[i] for i, _ in ITEMS} == {i: plainly(v) for i, v in ITEMS}
    assert all(got[i] == [] for i in (900, 901, 902, 903))
    assert any(n.startswith("h") for i, _ in ITEMS for n, _ in got[i]) and any(n.startswith("p") for i, _ in ITEMS for n, _ in got[i])


def apply(before, updates):
    return merge.patch(merge.patch(before, updates, "id", "tags"), updates, "id", "extra_terms")


def seen(df):
    return {r.id: ([t.label for t in r.tags or []], r.extra_terms) for r in df.collect()}


def test_retag_writes_only_what_changes(spark):
    lib = items(spark)
    updates, states, versions = K.retag(lib, knowledge(spark), 1)
    first = {r.id: r for r in updates.collect()}
    assert states.count() == lib.count() and not {900, 901, 902, 903} & set(first)
    for i, v in ITEMS:
        names = [n for n, _ in plainly(v)]
        if names or i % 3 == 0:
            assert sorted(t.label for t in first[i].tags) == sorted(names + ["kept"] * (i % 3 == 0))
            assert "old" not in first[i].extra_terms.split()
    some = next(r for r in first.values() if "p1" in [t.label for t in r.tags])
    assert {"p1", "wide", "two", "words"} <= set(some.extra_terms.split())
    lib = apply(lib, updates)
    # a second run, the same knowledge in another order of rows: nothing is computed or written
    again, states2, versions2 = K.retag(lib, knowledge(spark, examples=EXAMPLES[::-1]), 2, states, versions)
    assert again.count() == 0
    assert K.stale(lib, knowledge(spark), states, versions).count() == 0
    assert {r.version for r in states2.collect()} == {2}
    # a changed prompt, a new head, other words, a label that went: as if all were computed anew
    prompts = {**{n: v for n, v in PROMPTS.items() if n != "p3"}, "p0": -PROMPTS["p0"]}
    heads = {**HEADS, "h9": (PROMPTS["p5"] * 9, -2.0, 0.65, 0.1, 0.2)}
    new = knowledge(spark, prompts=prompts, heads=heads, terms={**TERMS, "p2": ["brand new"]})
    third, states3, _ = K.retag(lib, new, 3, states2, versions2)
    whole, _, _ = K.retag(lib, new, 3)
    got, want = seen(third), seen(whole)
    assert got == want and 0 < len(got) < len(ITEMS)
    stale = K.stale(lib, new, states2, versions2)
    assert set(got) <= {r.id for r in stale.collect()} and stale.count() < lib.count()
    assert K.retag(apply(lib, third), new, 4, states3, versions2.unionByName(K.digests(new).withColumn("version", F.lit(3).cast("long"))))[0].count() == 0


def test_changed_inputs_and_anchors(spark):
    lib = items(spark)
    k = knowledge(spark)
    updates, states, versions = K.retag(lib, k, 1)
    lib = apply(lib, updates)
    edited = lib.withColumn("ocr_text", F.when(F.col("id") == 5, "gm pepe").otherwise(F.col("ocr_text"))).unionByName(spark.createDataFrame([(77_000, ITEMS[0][1].tolist(), "", [], "")], lib.schema)).filter("id <> 6")
    stale = K.stale(edited, k, states, versions)
    assert {r.id for r in stale.collect()} == {5, 77_000}
    _, after, _ = K.retag(edited, k, 2, states, versions)
    assert {r.id for r in after.collect()} == {r.id for r in edited.collect()}
    other = knowledge(spark, anchors=ANCHORS[:2])
    assert K.stale(lib, other, states, versions).count() == lib.count()


def test_vocabulary_and_associations(spark):
    labels = spark.createDataFrame([("a", "c", "photo of a"), ("b", "c", "photo of b")], "label string, category string, prompt string")
    keys = {r[0]: r[1] for r in labels.select("label", K.label_key(F.col("label"), F.col("prompt"))).collect()}
    cache = spark.createDataFrame([(keys["a"], "m", [1.0]), ("label:old:a", "m", [2.0]), ("search:x", "m", [3.0]), ("label:old:a", "other", [4.0])], "key string, model string, vector array<double>")
    ready, missing, pruned = K.vocabulary(labels, cache, "m")
    assert [tuple(r) for r in ready.collect()] == [("a", "c", [1.0])]
    assert [(r.key, r.label) for r in missing.collect()] == [(keys["b"], "b")]
    assert sorted((r.key, r.model) for r in pruned.collect()) == sorted([(keys["a"], "m"), ("search:x", "m"), ("label:old:a", "other")])
    curated = spark.createDataFrame([("a", ["one", "two"])], "label string, terms array<string>")
    taught = spark.createDataFrame([(2, "a", ["two", "four"]), (1, "a", ["three"]), (3, "b", []), (4, "c", None)], "id long, label string, associations array<string>")
    assert {r.label: r.terms for r in K.associations(curated, taught).collect()} == {"a": ["one", "two", "three", "four"]}


def test_empty_model(spark):
    k = knowledge(spark, prompts={}, heads={}, examples=[], anchors=[], terms={})
    updates, states, _ = K.retag(items(spark), k, 1)
    assert states.count() == len(ITEMS) + 4
    assert all([t.label for t in r.tags] == ["kept"] for r in updates.collect())
