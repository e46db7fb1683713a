"""Exact cases of search, similarity, learning, evaluation, merges, ranges and mining."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import evaluate, graph, intervals, learn, merge, mining, paging, search, similar


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fusion_orders(spark):
    lists = spark.createDataFrame([(1, 0, 1, 1.0), (2, 0, 2, 1.0), (3, 0, 3, 1.0), (3, 1, 1, 2.0), (2, 1, 2, 2.0), (4, 1, 3, 2.0)], "id long, list int, rank int, weight double")
    assert [r.id for r in search.fuse(lists).orderBy(F.desc("rrf_score"), "seen").collect()] == [3, 2, 4, 1]
    lists = spark.createDataFrame([(i, 0, i, 1.0) for i in (1, 2, 3, 4)] + [(3, 1, 1, 2.0)], "id long, list int, rank int, weight double")
    assert [r.id for r in search.fuse(lists).orderBy(F.desc("rrf_score"), "seen").collect()] == [3, 1, 2, 4]


@pytest.fixture(scope="module")
def items(spark):
    data = [(1, "image", [1.0, 0.0], "a smug cat", [("smug", "emotion", 1.0, "manual")], 5), (2, "image", [0.6, 0.8], "education for all", [], 6), (3, "image", [0.0, 1.0], "dog", [], 7)]
    return spark.createDataFrame([(i, k, e, None, t, g, m) for i, k, e, t, g, m in data], "id long, kind string, embedding array<float>, caption_embedding array<float>, search_text string, tags array<struct<label:string,category:string,score:double,source:string>>, modified_at long")


def test_search(spark, items):
    found = search.search(items, [0.0, 1.0], "smug").orderBy("rank").collect()
    assert [r.id for r in found] == [1, 3, 2] and found[0].hybrid_score == pytest.approx(0.95 + 5.5)
    assert found[0].rrf_score == pytest.approx(1 / 61)
    assert {r.id for r in search.scope(items, "video", "x").collect()} == {1, 2, 3}
    assert search.scope(items, "video", " ").count() == 0
    fused = search.search(items, [0.0, 1.0], "smug", lexical="bm25").orderBy("rank").collect()
    assert fused[0].id == 1 and fused[0].rrf_score == pytest.approx(1 / 61 + 2 / 61)
    assert rows(search.bm25(items, ["search_text"], [1.0], ["smug cat"]).select("id")) == [(1,)]
    assert search.bm25(items, ["search_text"], [1.0], []).count() == 0


def test_expansion(spark):
    vocabulary = spark.createDataFrame([("Angry", ["angry", "rage"], [1.0, 0.0], "library"), ("angry", ["angry", "mad"], [1.0, 0.0], "curated"), ("calm", ["calm"], [0.0, 1.0], "taught")], "label string, terms array<string>, vector array<float>, source string")
    hits = search.semantic_labels(search.expansion_candidates(vocabulary), [1.0, 0.0])
    assert search.expanded_terms(hits, ["mad"]).first().expanded == ["angry"]


def test_similarity(spark, items):
    assert [r.id for r in similar.similar_items(items, [0.0, 1.0], exclude=3).collect()] == [2, 1]
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[100:] = x[:200] + rng.normal(0, 0.05, (200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    for block in (4096, 37):
        pairs = {(r.a, r.b): r.score for r in similar.similarity_pairs(df, 0.95, block).collect()}
        full = x @ x.T
        assert set(pairs) == {(i, j) for i in range(300) for j in range(i + 1, 300) if full[i, j] >= 0.95}
        assert all(abs(full[i, j] - s) < 1e-9 for (i, j), s in pairs.items())


def clustered(spark, data):
    df = spark.createDataFrame(data, "id long, embedding array<double>, text string, tags array<string>")
    return [tuple(r) for r in similar.clusters(df, 0.86).collect()]


def test_clusters(spark):
    assert clustered(spark, [(1, [1.0, 0.0], "one", ["This is fine", "meme"]), (2, [0.99, 0.1], "two", ["this is fine"]), (3, [0.0, 1.0], "x", [])]) == [(1, 2, 2, True, "this is fine")]
    assert clustered(spark, [(1, [1.0, 0.0], "Same ", []), (2, [1.0, 0.0], "same", [])]) == [(1, 2, 1, False, "")]
    assert clustered(spark, [(i, [1.0, 0.0], "", []) for i in (4, 2, 3)]) == [(2, 3, 0, True, "")]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (7, 7)], "a long, b long")
    assert rows(graph.components(edges)) == [(i, 1) for i in range(1, 41)] + [(90, 90), (100, 90)]


def test_propagation(spark):
    at = lambda c: [c, (1 - c * c) ** 0.5]
    schema = "id long, embedding array<double>, visual_embedding array<double>, visual_model string, durable boolean"
    source = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0], "m", False)], schema)
    others = spark.createDataFrame([(2, at(0.1), at(0.75), "m", False), (3, at(0.1), at(0.65), "m", False), (4, at(0.9), None, "", False), (5, at(0.87), at(0.99), "old", False), (6, at(1.0), at(1.0), "m", True), (7, [], None, "", False)], schema)
    found = similar.propagate(source, others, "m").collect()
    assert [(r.id, r.space) for r in found] == [(2, "visual"), (4, "primary")] and found[0].margin == pytest.approx(0.05)


def test_twins_and_frames(spark):
    schema = "id long, ocr_text string, embedding array<double>"
    new = spark.createDataFrame([(1, " Hello ", [1.0, 0.0]), (2, "", [1.0, 0.0]), (3, "else", [1.0, 0.0])], schema)
    old = spark.createDataFrame([(8, "hello", [1.0, 0.0]), (9, "hello", [1.0, 0.0]), (10, "else", [0.5, 0.5])], schema)
    assert rows(similar.twins(new, old).select("id", "twin")) == [(1, 9)]
    frames = spark.createDataFrame([(1, k, [float(np.cos(a)), float(np.sin(a))]) for k, a in enumerate((0, 0.01, 0.5, 0.02, 1.0))], "id long, ordinal int, embedding array<double>")
    assert [r.ordinal for r in similar.distinct_frames(frames).orderBy("ordinal").collect()] == [0, 2, 4]


def test_training_set_of_a_head(spark):
    x, y, z = np.eye(3)
    mix = lambda c: c * x + np.sqrt(1 - c * c) * y
    mean = np.array([0.1, 0.2, 0.3])
    background = np.stack([mix(0.9), mix(0.7), z] + [z] * 46 + [mix(0.65)])  # one too near, two hard
    against, kept, near = learn.training_set(x[None], y[None], background, np.stack([mix(0.86), z]), mean)
    assert near.round(6).tolist() == [0.7] + [0.0] * 47 + [0.65] and len(kept) == 51
    # 51 kept rows, one of the two other positives, and the correction twice (51 / 25 rounded).
    assert len(against) == 51 + 1 + 2 and np.allclose(against[51], z - mean) and np.allclose(against[-2:], y - mean)
    assert np.allclose(kept[0], mix(0.7) - mean) and np.allclose(kept[1], kept[0]) and np.allclose(kept[-1], kept[-2])
    examples = spark.createDataFrame([("a", x.tolist(), True), ("a", y.tolist(), False), ("b", mix(0.86).tolist(), True), ("b", z.tolist(), True)], "label string, vector array<double>, positive boolean")
    head = learn.train_heads(examples, background, mean).filter("label = 'a'").first()
    w, b = learn.fit_logistic(x[None] - mean, against)
    assert np.allclose(head.weights, w, atol=1e-6) and abs(head.bias - b) < 1e-6
    assert abs(head.knn_mean - (0.7 + 0.65) / 49) < 1e-9 and head.threshold >= 0.6
    alone = learn.train_heads(examples.filter("label = 'a'"), np.zeros((0, 3)))
    assert alone.count() == 1 and learn.train_heads(examples.limit(0), background).count() == 0


def test_learning(spark):
    rng = np.random.default_rng(1)

    def near(v, n):
        out = np.asarray(v) + rng.normal(0, 0.1, (n, 8))
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).tolist()

    one, two = np.eye(8)[0], np.eye(8)[1]
    back = np.array(near(np.eye(8)[4], 40) + near(two, 10))
    examples = spark.createDataFrame([("one", v, True) for v in near(one, 5)], "label string, vector array<double>, positive boolean")
    heads = learn.train_heads(examples, back)
    asked = spark.createDataFrame([(1, near(one, 1)[0]), (2, near(two, 1)[0])], "id long, embedding array<double>")
    found = {r.id: r for r in learn.score_heads(asked, heads).collect()}
    assert found[1].hit and not found[2].hit and 0.6 <= heads.first().threshold <= 0.92
    labels = spark.createDataFrame([("one", one.tolist()), ("two", two.tolist())], "label string, vector array<double>")
    assert {(r.id, r.label) for r in learn.zero_shot(asked, labels, [two.tolist()]).collect()} == {(1, "one"), (2, "two")}
    a = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.9)], "id long, label string, score double")
    b = spark.createDataFrame([(1, "X", 0.3)], "id long, label string, score double")
    assert [(r.label, r["rank"]) for r in learn.merge_classified(a, b).orderBy("rank").collect()] == [("X", 1), ("y", 2)]


def test_retrieval_metrics(spark):
    out = evaluate.retrieval(spark.createDataFrame([(1,), (1,), (2,)], "rank int")).first()
    assert (out.queries, out.recall_at_1, out.recall_at_5, out.mrr) == (3, pytest.approx(2 / 3), 1.0, pytest.approx(2.5 / 3))
    empty = evaluate.retrieval(spark.createDataFrame([], "rank int")).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0.0, 0.0)
    two = evaluate.retrieval(spark.createDataFrame([(1,), (2,)], "rank int"), (1, 3)).first()
    assert (two.recall_at_1, two.recall_at_3, two.mrr) == (0.5, 1.0, 0.75)
    ranked = spark.createDataFrame([("q", 1, True), ("q", 2, False), ("q", 3, True), ("z", 1, False)], "query string, rank int, relevant boolean")
    assert evaluate.aspects(ranked).first()["map"] == pytest.approx((1 + 2 / 3) / 2)
    assert evaluate.auc(spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True)], "score double, correct boolean")).first().auc == pytest.approx(0.75)
    assert evaluate.auc(spark.createDataFrame([(1.0, True)], "score double, correct boolean")).first().auc is None
    a, b = (spark.createDataFrame([(x, 0.5)], "mrr double, recall double") for x in (0.9, 0.8))
    assert [r.metric for r in evaluate.gate(a, b).collect()] == ["mrr"] and evaluate.gate(b, a).count() == 0
    images = spark.createDataFrame([(1, [(0.9, True), (0.5, False)]), (2, [])], "id long, predictions array<struct<score:double,correct:boolean>>")
    assert tuple(evaluate.rule_metrics(images).first()) == (2, 0.5, 1.0, 0.5, 1, 1)


LIVE = "uri string, name string, kind string, embedding array<double>, ocr_text string, caption string, caption_embedding array<double>, transcript string, tags string, extra_terms string, vision_state string, audio_state string, thumb_uri string, indexed_at long, modified_at long, pending boolean"


def item(**given):
    base = dict(uri="u", name="n", kind="image", embedding=[1.0], ocr_text="", caption="", caption_embedding=None, transcript="", tags="[]", extra_terms="", vision_state="pending", audio_state="none", thumb_uri="", indexed_at=1, modified_at=1, pending=False)
    return tuple((base | given).values())


def test_index_upsert(spark):
    live = spark.createDataFrame([item(caption="kept", caption_embedding=[2.0], transcript="said", vision_state="done", audio_state="done", thumb_uri="old", ocr_text="before", pending=True)], LIVE)
    scan = spark.createDataFrame([item(ocr_text="after", indexed_at=9, vision_state="failed", audio_state="pending", thumb_uri="", embedding=[3.0]), item(uri="v")], LIVE).drop("caption", "caption_embedding", "transcript")
    out = {r.uri: r for r in merge.index_upsert(live, scan).collect()}
    r = out["u"]
    assert (r.caption, r.caption_embedding, r.transcript, r.ocr_text, r.indexed_at, r.vision_state, r.audio_state, r.thumb_uri, r.pending, r.embedding) == ("kept", [2.0], "said", "after", 9, "done", "done", "old", False, [3.0])
    assert out["v"].caption == "" and not out["v"].pending


def test_restore_fills_gaps_only(spark):
    saved = spark.createDataFrame([item(caption="saved", tags='[{"label":"x"}]', extra_terms="t", embedding=[5.0], transcript="s", vision_state="done", audio_state="done", modified_at=7)], LIVE)
    mine = spark.createDataFrame([item(caption="mine", tags='[{"label":"y"}]', embedding=[1.0], vision_state="done")], LIVE)
    r = merge.additive_restore(mine, saved).first()
    assert (r.caption, r.tags, r.embedding, r.extra_terms, r.transcript, r.modified_at) == ("mine", '[{"label":"y"}]', [1.0], "t", "s", 1)
    blank = spark.createDataFrame([item(embedding=[], tags="[]", pending=True, modified_at=0)], LIVE)
    r = merge.additive_restore(blank, saved).first()
    assert (r.caption, r.tags, r.embedding, r.pending, r.modified_at) == ("saved", '[{"label":"x"}]', [5.0], False, 7)
    again = merge.additive_restore(merge.additive_restore(blank, saved), saved).first()
    assert again == r
    empty = spark.createDataFrame([item(caption="c", embedding=[])], LIVE)
    r = merge.additive_restore(blank, empty).first()
    assert r.pending and r.caption == "c"


def test_imports_and_deletes(spark):
    schema = "label string, vector array<double>, positive boolean, pack string"
    known = spark.createDataFrame([("a", [0.1], True, "p"), ("b", [0.2], True, "q")], schema)
    more = spark.createDataFrame([("a", [0.1000001], True, ""), ("a", [0.1], False, ""), ("a", [0.1], False, "")], schema)
    after, counts = merge.import_exemplars(known, more, "p")
    assert after.count() == 3 and tuple(counts.first()) == (1, 2, 0)
    after, counts = merge.import_exemplars(known, more, "p", replace=True)
    assert after.count() == 3 and tuple(counts.first()) == (2, 1, 1)
    ids = spark.createDataFrame([("u",), ("v",)], "uri string")
    assert [d.count() for d in merge.delete(ids, ids.filter("uri = 'u'"), "uri", (ids.withColumnRenamed("uri", "at"), "at"))] == [1, 1]
    assert merge.changed(known, after.filter("label = 'b'"), "label", ["vector", "pack"]).count() == 0
    assert rows(merge.insert_missing(ids, spark.createDataFrame([("v",), ("w",), ("w",)], "uri string"), "uri")) == [("u",), ("v",), ("w",)]


def test_paging(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(10)], "id long, modified_at long")
    assert [r.id for r in paging.recent(df, 3).collect()] == [9, 8, 7]
    page = paging.before(df, 3, 7, 3)
    assert [r.id for r in page.collect()] == [6, 5, 4]
    assert paging.append(paging.recent(df, 4), page).count() == 6


def test_ranges(spark):
    df = spark.createDataFrame([("e", 0, 10), ("e", 10, 20), ("e", 50, 40), ("e", 30, 99), ("e", 35, 60), ("f", -5, 3)], "entity string, start_us long, end_us long")
    normal = intervals.islands(df, F.lit(80))
    assert rows(normal) == [("e", 0, 20), ("e", 30, 80), ("f", 0, 3)]
    lengths = spark.createDataFrame([("e", 100), ("f", 3), ("g", 9)], "entity string, duration_us long")
    assert rows(intervals.gaps(normal, lengths)) == [("e", 20, 30), ("e", 80, 100), ("g", 0, 9)]
    points = spark.createDataFrame([("e", t) for t in (0, 19, 20, 30, 80, 81)], "entity string, time_us long")
    assert rows(intervals.source_to_output(points, normal)) == [("e", 0, 0), ("e", 19, 19), ("e", 20, None), ("e", 30, 20), ("e", 80, 70), ("e", 81, None)]
    back = spark.createDataFrame([("e", t) for t in (0, 20, 70, 71)], "entity string, output_us long")
    assert rows(intervals.output_to_source(back, normal)) == [("e", 0, 0), ("e", 20, 30), ("e", 70, 80), ("e", 71, None)]
    cuts = spark.createDataFrame([("e", 5), ("e", 5), ("e", 20), ("e", 40)], "entity string, at_us long")
    assert rows(intervals.segments(normal, cuts)) == [("e", 0, 5), ("e", 5, 20), ("e", 30, 40), ("e", 40, 80), ("f", 0, 3)]
    assert rows(intervals.nearest_boundary(spark.createDataFrame([("e", 24), ("e", 25), ("e", 26), ("e", 90), ("e", 5)], "entity string, time_us long"), normal)) == [("e", 5, 5), ("e", 24, 20), ("e", 25, 20), ("e", 26, 30), ("e", 90, 80)]
    layers = spark.createDataFrame([("e", 1, 15, 35), ("e", 2, 21, 29)], "entity string, layer long, start_us long, end_us long")
    assert rows(intervals.overlap_hull(layers, normal, 10)) == [("e", 1, 15, 35)]
    with pytest.raises(Exception, match="too many"):
        intervals.checked(normal, 1).collect()


def test_keyframes(spark):
    k = spark.createDataFrame([("e", 10, 1.0, 0), ("e", 10, 2.0, 1), ("e", 20, 4.0, 2)], "entity string, time_us long, value double, ordinal int")
    keys = intervals.normal_keyframes(k, 0, 100)
    points = spark.createDataFrame([("e", t) for t in (5, 10, 15, 20, 25)], "entity string, time_us long")
    assert [r[2] for r in rows(intervals.interpolate(points, keys))] == [2.0, 2.0, 3.0, 4.0, 4.0]
    assert [r[2] for r in rows(intervals.interpolate(points, keys, hold=True))] == [2.0, 2.0, 2.0, 4.0, 4.0]
    assert intervals.frame_ladder(3) == [300, 2324, 18000] and intervals.frame_ladder(0) == []


def test_mining(spark):
    counts = spark.createDataFrame([("pill", 5), ("pills", 7), ("goblin", 2), ("once", 1)], "term string, count long")
    assert [(r.label, r["count"]) for r in mining.baseline(counts).collect()] == [("Pills", 7), ("Goblin", 2)]
    several = spark.createDataFrame([("pill", 0.5, "a"), ("pills", 0.7, "b"), ("x", 9.0, "a")], "term string, weight double, source string")
    assert [(r.label, r.source) for r in mining.multi_source_baseline(several).collect()] == [("Pills", "b")]
    pages = spark.createDataFrame([(1, '<a href="/tag/goblin"><a href="/tags/goblin">'), (2, '"tags": ["goblin"]')], "page_id long, html string")
    assert rows(mining.frequencies(mining.page_terms(pages), "page_id")) == [("goblin", 2)]
    robots = spark.createDataFrame([("User-agent: x\nDisallow: /a\nUser-agent: *\nDisallow: /b # no\nDisallow:",)], "body string")
    assert rows(mining.robots_disallowed(robots)) == [("/b",)]
    two = spark.createDataFrame([("User-agent: *\nDisallow: /a\nUser-agent: x\nDisallow: /b",), ("User-agent: y\nDisallow: /c\nUser-agent: *\nDisallow: /d",)], "body string")
    assert sorted(rows(mining.robots_disallowed(two))) == [("/a",), ("/d",)]
    assert rows(mining.sitemap_links(spark.createDataFrame([("<loc> http://a </loc><loc>http://b</loc>",)], "xml string"))) == [("http://a",), ("http://b",)]
