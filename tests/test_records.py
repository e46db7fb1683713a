"""Records, rollups, predictions, schemas."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.functions import records
from gleanery.operators import evaluate, rollups


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_schemas(spark):
    for ddl in schemas.DDL.values():
        assert spark.createDataFrame([], ddl).count() == 0


def test_rules(spark):
    ids = [f"item{i}" for i in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert {r.id for r in df.filter(records.held_out("id")).collect()} == {i for i in ids if int(hashlib.sha1(i.encode()).hexdigest(), 16) % 20 == 0}
    assert value(spark, records.items_per_hour(F.lit(0.0))) == 6 and value(spark, records.items_per_hour(F.lit(0.5))) == 60 and value(spark, records.items_per_hour(F.lit(0.98))) == float("inf")
    assert value(spark, records.contrast(F.lit("#000000"), F.lit("#ffffff"))) == pytest.approx(21)


def test_new_rows_and_records(spark):
    scan = spark.createDataFrame([("a", "image", [1.0], None, False), ("b", "video", [1.0], "m", True), ("c", "video", [1.0], "m", None)], "uri string, kind string, embedding array<float>, visual_model string, degraded boolean")
    out = {r.uri: r for r in records.new_rows(scan, "m").collect()}
    assert (out["a"].vision_state, out["a"].audio_state, out["a"].embedding) == ("pending", "none", [1.0])
    assert (out["b"].vision_state, out["b"].audio_state, out["b"].embedding, out["b"].visual_model) == ("failed", "none", [], "failed:m")
    assert out["c"].audio_state == "pending"
    row = (1, "u", "n", "image", [1.0], None, "", None, "c", None, "", [], "", "done", "none", "failed", 1, 1, False)
    r = records.records(spark.createDataFrame([row], schemas.DDL["items"])).first()
    assert r.ocr_text == "" and r.thumb_uri is None and "embedding" not in r.asDict()


def test_pooled_frames(spark):
    frames = spark.createDataFrame([(1, 0, [1.0, 0.0], "Hello"), (1, 1, [0.0, 1.0], "hello world"), (1, 2, [0.0, 1.0], "other"), (1, 3, [0.0, 1.0], None)], "id long, ordinal int, embedding array<double>, text string")
    r = records.pooled_frames(frames).first()
    assert r.ocr_text == "hello world\nother" and sum(x * x for x in r.embedding) == pytest.approx(1)


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(1, "a", "t", [1.0], [], "u", True, "self", "", 1, "m"), (2, "a", "t", [1.0], [], "u", False, "pack", "p", 1, "m"), (3, "b", "t", [1.0], ["z"], "u", True, "pack", "p", 1, "m")]
    return spark.createDataFrame(rows, schemas.DDL["exemplars"])


def test_rollups(spark, taught):
    base = ["u", "n", "video", [1.0], None, "", "", "", None, ""]
    rows = [(i, *base, [("A ", "t", 1.0, "manual"), ("a", "t", 0.5, "ocr")], "", "done", "none", thumb, 1, 1, False) for i, thumb in enumerate(("", "failed", "x"))]
    items = spark.createDataFrame(rows, schemas.DDL["items"])
    assert [tuple(r) for r in rollups.taught_labels(taught, items).orderBy("label").collect()] == [("a", 1, 1, True, True, ["p"], 3), ("b", 1, 0, False, True, ["p"], 0)]
    assert [tuple(r) for r in rollups.packs(taught).collect()] == [("p", 2, 2)]
    assert tuple(rollups.poster_stats(items).first()) == (3, 1, 1, 1)
    assert rollups.knowledge_version(taught, items).first().version == "3:6:3"
    assert rollups.manual_tag_stamp(items).first() == rollups.manual_tag_stamp(items.orderBy(F.desc("id"))).first() != rollups.manual_tag_stamp(items.limit(2)).first()
    assert {r.label: r.associations for r in rollups.associations(taught).collect()} == {"a": [], "b": ["z"]}
    files = spark.createDataFrame([("h", "x"), ("h", "y"), ("k", "z")], "hash string, uri string")
    assert rollups.share_dedupe(files, files.filter("hash = 'k'")).count() == 1
    assert rollups.live_content(files, spark.createDataFrame([("z",)], "uri string")).count() == 1


@pytest.mark.parametrize("rule,want", [("margin", [["cat"], []]), ("softmax", [["cat"], []])])
def test_predictions(spark, rule, want):
    images = spark.createDataFrame([(1, [1.0, 0.0, 0.0], ["black cat"]), (2, [0.0, 0.0, 1.0], ["dog"])], "id long, vector array<double>, truth array<string>")
    labels = spark.createDataFrame([("cat", ["cat"], [0.9, 0.1, 0.0]), ("dog", ["dog"], [0.0, 1.0, 0.0])], "label string, terms array<string>, vector array<double>")
    rows = evaluate.predictions(images, labels, [[0.0, 0.0, 1.0]], rule).orderBy("id").collect()
    assert [[p.label for p in r.predictions] for r in rows] == want and rows[0].predictions[0].correct
