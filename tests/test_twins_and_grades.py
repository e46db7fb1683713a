import json
import random
import struct

import xxhash
from pyspark.sql import functions as F

from gleanery.operators import facets, grading, similar
from gleanery.sources import mirror


def test_twins_equal_brute_force(spark):
    rng = random.Random(1)
    vectors = [[1.0, 0.0], [0.8, 0.6], [0.6, 0.8], [0.0, 1.0]]
    items = [(i, rng.choice(["Same text", " same TEXT", "other", "", None]), rng.choice(vectors)) for i in range(80)] + [(7, "other", vectors[0])]
    known = items[:50]
    df = lambda rows: spark.createDataFrame(rows, "id long, ocr_text string, embedding array<double>")
    plain = lambda t: (t or "").strip().lower()
    want = set()
    for i, t, v in items:
        near = [(sum(a * b for a, b in zip(v, w)), j) for j, u, w in known if plain(t) and plain(u) == plain(t) and j != i]
        near = [n for n in near if n[0] >= 0.9]
        if near:
            want.add((i, max(near)[1], round(max(near)[0], 9)))
    got = similar.twins(df(items), df(known), 0.9)
    assert {(r.id, r.twin, round(r.score, 9)) for r in got.collect()} == want
    assert similar.twins(df([(i, "copy", [1.0]) for i in range(300)]), df([(i, "copy", [1.0]) for i in range(300)])).count() == 300


def test_manifest_digest_equals_python(spark):
    rows = [("a", "text ä", None), ("a", "text ä", None), ("b", "", 3), ("c", "x\n\"y\"", 4)]
    got = {(r.chunk, r.rows, r.digest) for r in mirror.manifest(mirror.chunks(spark.createDataFrame(rows, "name string, text string, n int"))).collect()}
    chunks = {r.name: r.chunk for r in mirror.chunks(spark.createDataFrame(rows, "name string, text string, n int")).collect()}

    def hashed(seed, *texts):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        for t in texts:
            h = xxhash.xxh64_intdigest(t.encode(), h)
        return h - (1 << 64) if h >> 63 else h

    want = {}
    for name, text, n in rows:
        payload = json.dumps({"name": name, "text": text} | ({} if n is None else {"n": n}), separators=(",", ":"), ensure_ascii=False)
        k, a, b = want.get(chunks[name], (0, 0, 0))
        want[chunks[name]] = (k + 1, a + hashed(1, name, payload), b + hashed(2, name, payload))
    assert got == {(c, k, f"{a}:{b}") for c, (k, a, b) in want.items()}


def test_grades_of_odd_rows(spark):
    tag = "array<struct<label:string,source:string>>"
    items = spark.createDataFrame([(1, None, [("Big Cat", "manual"), ("big  cat", "exemplar"), ("a", "vision")]), (2, "BIG cat here", [("Big Cat", "manual")]), (3, None, [("x", "manual")]), (4, "c", None), (5, "c", [])], f"id long, caption string, tags {tag}")
    said = grading.assertions(items)
    assert sorted((r.id, r.label, r.agreed) for r in said.collect()) == [(1, "big cat", False), (2, "big cat", True), (3, "x", None)]
    assert [tuple(r) for r in grading.missed(said).collect()] == [("big cat", 1)]
    assert tuple(grading.agreement_summary(said).first()) == (3, 1, 2, 1, 0.5)
    assert tuple(grading.agreement_summary(said.limit(0)).first()) == (0, 0, 0, 0, 0.0)
    none = spark.createDataFrame([], "id long, must_find array<string>, expect_facets array<string>")
    guesses = spark.createDataFrame([(1, ["Dog"])], "id long, tags array<string>")
    assert tuple(grading.case_summary(grading.graded_cases(none, guesses, spark.createDataFrame([], "label string, facet string"))).first()) == (0, 0.0, 1.0)
    queries = spark.createDataFrame([(1, "a", [1.0, 0.0], 1), (2, "b", [0.0, 1.0], 2), (3, "a", [0.0, 1.0], 3), (4, "c", [1.0, 0.0], 9)], "number long, query string, vector array<double>, expected_id long")
    images = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.5, 0.5]), (7, [1.0, 0.0])], "id long, vector array<double>")
    for size in (1, 4096):
        r = grading.zero_shot(images, queries, size).first()
        assert (r.n, r.labels, round(r.recall_at_1, 6), r.recall_at_3) == (3, 3, round(2 / 3, 6), 1.0) and abs(r.mrr - (1 + 1 / 3 + 1) / 3) < 1e-9
    tags = [(i, t) for i in range(4) for t in ("Big-Cat", "big_cat", "no", "x" * 41, "one two three four five six")] + [(9, "rare")]
    kept, relevant = grading.golden_aspects(spark.createDataFrame(tags, "id long, tag string"))
    assert [tuple(r) for r in kept.collect()] == [("big cat", 4)] and relevant.count() == 4


def test_any_number_of_phrases(spark):
    rng = random.Random(3)
    labels = ["endgame overs", "go", "a", "It's  over", "xyz"] + ["".join(rng.choices("abc d", k=rng.randrange(1, 14))) for _ in range(60)]
    phrases = [("game over", "action"), ("go", "topic"), ("a", "tone"), ("over", "emotion"), ("zz", "tone")] + [("".join(rng.choices("abcd", k=rng.randrange(1, 5))), "format") for _ in range(40)]
    got = facets.tag_facets(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([("xyz", "person")], "word string, facet string"), spark.createDataFrame(phrases, "phrase string, facet string"))
    want = {(x, f) for x in labels for p, f in phrases if p in x.strip().lower() and x.strip()} | {("xyz", "person")}
    assert {tuple(r) for r in got.collect()} == want
