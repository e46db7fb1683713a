"""Edits of ranges and signals against plain Python."""

import random

from pyspark.sql import functions as F

from gleanery.operators import evaluate, intervals, states


def test_segments_are_removed(spark):
    ranges = spark.createDataFrame([(1, 0, 100), (1, 200, 300), (2, 0, 50), (3, 0, 50)], "entity long, start_us long, end_us long")
    splits = spark.createDataFrame([(1, 40.2), (1, 40.0), (1, 250.0), (1, 150.0), (1, 100.0), (2, 20.0)], "entity long, at_us double")
    assert sorted(map(tuple, intervals.kept_splits(splits, ranges).collect())) == [(1, 40), (1, 250), (2, 20)]
    gone = spark.createDataFrame([(1, 40), (2, 20), (3, 0)], "entity long, start_us long")
    left = sorted(map(tuple, intervals.without_segment(ranges, splits, gone).select("entity", "start_us", "end_us").collect()))
    assert left == [(1, 0, 40), (1, 200, 300), (2, 0, 20), (3, 0, 50)]  # the last one would leave nothing


def test_splits_by_brute_force(spark):
    rng = random.Random(2)
    ranges, splits, asked = [], [], []
    for e in range(30):
        at = 0
        for _ in range(4):
            a = at + rng.randrange(1, 40)
            at = a + rng.randrange(1, 80)
            ranges.append((e, a, at))
        splits += [(e, float(rng.randrange(300))) for _ in range(6)]
        asked += [(e, float(rng.randrange(300))) for _ in range(20)]
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    found = intervals.inserted_splits(frame(asked, "entity long, at_us double"), frame(splits, "entity long, at_us double"), frame(ranges, "entity long, start_us long, end_us long"), 5)
    wanted = set()
    for e, at in asked:
        own = next(((a, b) for x, a, b in ranges if x == e and a < at < b), None)
        points = [p for x, p in splits if own and x == e and own[0] < p < own[1]]
        fits = own is not None and at not in points and all(abs(at - p) >= 5 for p in [*own, *points])
        wanted.add((e, int(at), fits))
    assert {tuple(r) for r in found.collect()} == wanted


def test_tick_interval(spark):
    rows = spark.createDataFrame([(10_000_000, 1000.0), (0, 1000.0), (10_000_000, 0.0), (500_000, 5000.0)], "d long, px double")
    found = [r[0] for r in rows.select(intervals.tick_interval(F.col("d"), F.col("px"), 60.0, 40, 100_000)).collect()]
    for (d, px), n in zip(((10_000_000, 1000), (0, 1000), (10_000_000, 0), (500_000, 5000)), found):
        interval, need = 100_000, max(60 * d / px if px else d, d / 40)
        while d > 0 and interval < need:
            interval *= 2
        assert n == interval


def test_signals(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "id long, embedding array<double>")
    labels = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "label string, vector array<double>")
    found = {(r.id, r.signal): (r.label, r.score) for r in evaluate.signals(items, labels, [[0.0, 1.0]]).collect()}
    assert found[1, "biased"] == ("x", 1.0) and found[1, "gap"] == ("x", 1.0)
    assert found[2, "cosine"][0] == "y" and abs(found[2, "cosine"][1] - 0.8) < 1e-12 and abs(found[2, "biased"][1] - 0.4) < 1e-12 and abs(found[2, "anchored"][1]) < 1e-12
    assert abs(found[2, "softmax"][1] - 1 / (2 + 2.718281828459045**-10)) < 1e-9 and abs(found[2, "gap"][1] - 0.2) < 1e-12


def test_of_several_changes_the_last_counts(spark):
    items = spark.createDataFrame([(1, "a", "failed"), (2, "b", "failed")], "id long, transcript string, audio_state string")
    said = spark.createDataFrame([(1, "x", 1), (1, "", 2), (9, "z", 1)], "id long, transcript string, at int")
    assert sorted(map(tuple, states.set_transcript(items, said).collect())) == [(1, "", "done"), (2, "b", "failed")]
