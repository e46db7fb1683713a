"""Files, mirrors and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanery.sources import files, mirror, tables
from gleanery.streaming import events


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_media_and_new_files(spark, tmp_path):
    for name in ("a.jpg", "b.MP4", "c.txt"):
        (tmp_path / name).write_bytes(b"xy")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.png").write_bytes(b"z")
    found = files.media(spark, str(tmp_path))
    assert rows(found.select("name", "kind", "length")) == [("a.jpg", "image", 2), ("b.MP4", "video", 2)]
    known = spark.createDataFrame([(r.uri, r.name == "b.MP4") for r in found.collect()], "uri string, pending boolean")
    assert [r.name for r in files.new_files(found, known).collect()] == ["b.MP4"]


def test_datasets_and_packs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"image": "x", "suffix": "cat, dog"}\n{"image": "y", "suffix": ""}\n')
    (tmp_path / "b.json").write_text(json.dumps([{"image": "x", "tags": ["dog", "fox"], "file": "f"}]))
    assert rows(files.image_tags(spark, f"{tmp_path}/a.jsonl", f"{tmp_path}/b.json")) == [("x", ["cat", "dog", "fox"])]
    taught = spark.createDataFrame([("a", "topic", [1.0, 2.0], ["z"], True), ("b", "topic", [1.0], [], False)], "label string, category string, vector array<double>, associations array<string>, positive boolean")
    pack = files.pack_json(taught, "mine", "m", 2)
    assert rows(files.parse_pack(pack, "m", 2).select("pack", "label", "vector", "positive")) == [("mine", "a", [1.0, 2.0], True)]
    assert files.parse_pack(pack, "other", 2).count() == 0
    assert files.parse_pack(spark.createDataFrame([("broken",)], "value string"), "m", 2).count() == 0


def test_zip_plan_and_names(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name in ("d/a.jpg", "e/a.jpg", "b.txt", "known.png"):
            z.writestr(name, "x")
    listed = [(i, n.filename, n.is_dir()) for i, n in enumerate(zipfile.ZipFile(tmp_path / "z.zip").infolist())]
    plan = files.zip_plan(spark.createDataFrame(listed, "ord int, path string, is_dir boolean"), spark.createDataFrame([("known.png",)], "name string"))
    assert [r.verdict for r in plan.orderBy("ord").collect()] == ["import", "duplicate", "unsupported", "duplicate"]
    taken = spark.createDataFrame([("a.png",), ("a-2.png",)], "name string")
    assert rows(files.fresh_name(spark.createDataFrame([("a.png",), ("b",)], "name string"), taken)) == [("a.png", "a-3.png"), ("b", "b")]
    crowd = spark.createDataFrame([("a.png",), *[(f"a-{i}.png",) for i in range(2, 1500) if i != 1203], ("x-02.y",), ("x.y",)], "name string")
    asked = spark.createDataFrame([("a.png",), ("a-1203.png",), ("x.y",), ("x-2.y",), ("x.y",)], "name string")
    assert sorted(rows(files.fresh_name(asked, crowd))) == [("a-1203.png", "a-1203.png"), ("a.png", "a-1500.png"), ("x-2.y", "x-2.y"), ("x.y", "x-3.y")]
    log = spark.createDataFrame([(1, "a", "s", 1), (2, "a", "s", 2), (3, "a", "t", 0)], "id long, name string, stage string, created_at long")
    assert [r.id for r in files.latest_errors(log).collect()] == [2, 3]


def test_mirror(spark, tmp_path):
    path = f"{tmp_path}/mirror"
    schema = "uri string, name string, caption string"
    items = spark.createDataFrame([(f"u{i}", f"n{i}", f"c{i}") for i in range(50)], schema)
    first = {r.chunk: r.digest for r in mirror.sync(items, path).collect()}
    edited = items.withColumn("caption", F.when(F.col("name") == "n7", "new").otherwise(F.col("caption"))).filter("name <> 'n8'")
    old = mirror.read_manifest(spark, path)
    assert mirror.changed_chunks(mirror.manifest(mirror.chunks(items)), old).count() == 0
    assert 1 <= mirror.changed_chunks(mirror.manifest(mirror.chunks(edited)), old).count() <= 2
    second = {r.chunk: r.digest for r in mirror.sync(edited, path).collect()}
    assert 1 <= sum(first.get(k) != v for k, v in second.items()) <= 2
    on_disk = spark.createDataFrame([(f"n{i}", f"v{i}") for i in range(40)], "name string, uri string")
    restored, counts = mirror.restore(spark, path, on_disk, "name string, caption string")
    found = {r.name: (r.uri, r.caption) for r in restored.collect()}
    assert found["n7"] == ("v7", "new") and found["n1"] == ("v1", "c1") and "n8" not in found and len(found) == 39
    assert tuple(counts.first()) == (39, 10, 0)


EVENTS = "ts timestamp, user long, key string, value double"


@pytest.fixture
def stream_of(spark, tmp_path):
    def make(*batches):
        path = f"{tmp_path}/in"
        for b in batches:
            spark.createDataFrame(b, "s double, user long, key string, value double").select(F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "user", "key", "value").coalesce(1).write.mode("append").parquet(path)
        return events.read(spark, path, EVENTS, 1)

    return make


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_debounce_stream_equals_batch(spark, stream_of):
    data = [(float(s), 1, "k", 1.0) for s in (0, 1, 2, 60, 61, 500)] + [(10_000.0, 2, "k", 1.0)]
    stream = stream_of(data[:4], data[4:])
    out = run(spark, events.debounce(stream, events.INTERACTIVE, ["user"]), "bursts")
    assert sorted(r.events for r in out.filter("user = 1").collect()) == [1, 2, 3]
    assert events.debounce(spark.createDataFrame([], EVENTS), "8 seconds", ["user"]).count() == 0


def test_redelivery_and_windows(spark, stream_of):
    stream = stream_of([(0.0, 1, "a", 1.0), (1.0, 1, "a", 1.0)], [(2.0, 1, "a", 2.0), (3.0, 1, "b", 2.0)])
    assert run(spark, events.once(stream, ["key"]), "once_each").count() == 2
    assert rows(run(spark, events.tumbling(stream, "1 minute", ["user"]).select("n", "total"), "totals", "complete")) == [(4, 6.0)]


def test_throttle(spark, stream_of):
    stream = stream_of([(0.0, 1, "a", 1.0), (0.05, 1, "a", 1.0), (0.2, 1, "a", 1.0)], [(0.25, 1, "a", 1.0), (0.4, 1, "a", 1.0), (0.1, 2, "a", 1.0)])
    out = run(spark, events.throttle(stream, "user", 100), "seeks")
    assert sorted((r.user, r.ts.microsecond) for r in out.collect()) == [(1, 0), (1, 200_000), (1, 400_000), (2, 100_000)]


def test_drain_upserts_by_batch(spark, stream_of, tmp_path):
    stream = stream_of([(0.0, 1, "a", 1.0), (1.0, 2, "b", 1.0)], [(2.0, 1, "a", 5.0)])
    table = f"{tmp_path}/table"
    events.drain(stream, events.upsert_batches(table, "key", "ts"), f"{tmp_path}/check")
    last = spark.read.parquet(f"{table}/version=1")
    assert rows(last.select("key", "value")) == [("a", 5.0), ("b", 1.0)]
    assert tables.written(last, "copy").count() == 2
