import json

from pyspark.sql import functions as F

from gleanery.operators import mining
from gleanery.sources import harvest as H


def found(df):
    return sorted((r.term, r.weight, r.source) for r in df.collect())


def pages(spark, source, *payloads):
    return spark.createDataFrame([(source, i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)] + [("else", 0, '[{"name": "no"}]')], "source string, page int, payload string")


def test_unwrap(spark):
    rows = ['[1, "a"]', '{"memes": [1], "data": [2, 3]}', '{"x": 1, "other": [7]}', '{"data": {"memes": [4, 5]}}', "{}", "no json", None, "3", '{"memes": "text"}', '{"b": [1, 2], "a": [3]}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p string")
    got = {r.i: r.u for r in df.select("i", F.to_json(H.unwrapped(F.col("p"), ("data", "memes"))).alias("u")).collect()}
    assert got == {0: '[1,"a"]', 1: "[2,3]", 2: "[7]", 3: "[4,5]", 4: "[]", 5: "[]", 6: "[]", 7: "[]", 8: "[]", 9: "[3]"}


def test_names_and_tags(spark):
    one = {"depots": [{"name": " Milady ", "tags": ["smug", {"title": "Wave"}, "smug"]}, {"slug": "apu-the_frog", "tags": ["smug"]}, {"name": 5}, {"title": "Both", "label": "x", "tags": "none"}]}
    two = [{"displayName": "Last", "tags": [None, {"x": 1}, "Wave", 7]}]
    assert found(H.candidates(pages(spark, "named", one, "broken {", two, None), H.NAMED)) == sorted([("Milady", 100_000, "named"), ("apu the frog", 99_999, "named"), ("Both", 99_997, "named"), ("Last", 99_996, "named"), ("smug", 2, "named"), ("Wave", 2, "named")])


def test_plain_lists(spark):
    assert found(H.candidates(pages(spark, "templates", {"success": True, "data": {"memes": [{"name": "Drake"}, {"id": 1}, {"name": "Two Buttons"}]}}), H.TEMPLATES)) == [("Drake", 100_000, "templates"), ("Two Buttons", 99_998, "templates")]
    assert found(H.candidates(pages(spark, "categories", {"data": [{"name": "Reactions", "subcategories": [{"name": "Happy"}, {"no": 1}]}, {"subcategories": [{"name": "Lone"}]}]}), H.CATEGORIES)) == [("Happy", 2, "categories"), ("Lone", 2, "categories"), ("Reactions", 3, "categories")]
    assert found(H.candidates(pages(spark, "terms", {"tags": [{"searchterm": "wojak"}, {"name": "face"}, {"searchterm": 3}]}), H.TERMS)) == [("face", 2, "terms"), ("wojak", 2, "terms")]


def test_slugs_and_folders(spark):
    html = ["<a href='/memes/doge'>x</a><a href=\"/memes/Two-Words\"></a><a href='/memes/popular'>", None, "<a href='/memes/doge'><a href='/memes/last'><a href='/memes/a/b'>"]
    assert found(H.slug_candidates(pages(spark, "wiki", *html), "wiki", "/memes/", ("popular",))) == [("doge", 100_000, "wiki"), ("last", 99_998, "wiki"), ("two words", 99_999, "wiki")]
    items = [{"folder": "Pepe Memes", "tags": ["png", "sad", "PNG "]}, {"folder": "$TOSHI meme", "tags": ["sad"]}, {"folder": "Pepe", "tags": [{"name": "sad"}]}, {"folder": 4}]
    got = H.folder_candidates(pages(spark, "folders", items), H.Adapter("folders"))
    assert found(got) == [("Pepe", 100_000, "folders"), ("TOSHI", 99_999, "folders"), ("sad", 3, "folders")]
    merged = mining.multi_source_baseline(got.unionByName(H.slug_candidates(pages(spark, "wiki", *html), "wiki", "/memes/", ("popular",))), 3)
    assert [r.label for r in merged.orderBy(F.desc("weight"), "label").collect()] == ["Doge", "Pepe", "Toshi"]
