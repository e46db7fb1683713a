import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.operators import postings as P
from gleanery.operators import search

FIELDS = ("ocr", "name", "caption", "transcript", "tags", "extra")
SCHEMA = "id long, " + ", ".join(f"{f} string" for f in FIELDS) + ", other int"
WORDS = ["the"] * 12 + ["cat"] * 4 + [f"w{i}" for i in range(60)] + ["Émile", "x_y", "日本"]


def some(rng, ids):
    return [(i, *[None if rng.random() < 0.2 else " ".join(rng.choices(WORDS, k=rng.choice((0, 1, 3, 20)))) + rng.choice(("", "!", "...")) for _ in FIELDS], 1) for i in ids]


def plainly(rows, terms):
    docs = {r[0]: [re.findall(r"[^\W_]+", (t or "").lower()) for t in r[1:7]] for r in rows}
    n, mean = len(docs), sum(len(w) for d in docs.values() for w in d) / len(docs)
    out = {}
    for i, fields in docs.items():
        size, score = sum(map(len, fields)), 0.0
        for t in dict.fromkeys(terms):
            df = sum(any(t in f for f in d) for d in docs.values())
            tf = sum(x * f.count(t) for x, f in zip(search.BM25_FIELDS, fields))
            if tf:
                score += max(1e-6, math.log((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
        if score:
            out[i] = score
    return out


def best(rows, terms, k):
    return [(i, round(s, 9)) for i, s in sorted(plainly(rows, terms).items(), key=lambda x: (-x[1], x[0]))][:k]


def found(df):
    return [(r.id, round(r.bm25, 9)) for r in sorted(df.collect(), key=lambda r: r["rank"])]


QUERIES = [["the"], ["the", "cat"], ["w1", "the", "w2"], ["émile", "日本"], ["w3"], ["nowhere", "cat"], ["x"]]


def test_index_equals_brute_force_through_updates(spark, tmp_path):
    rng = random.Random(1)
    rows = {r[0]: r for r in some(rng, range(400))}
    index = P.build(spark.createDataFrame(list(rows.values()), SCHEMA), f"file://{tmp_path}/a", FIELDS)
    for terms in QUERIES[::2]:
        assert found(P.top(index, terms, 10)) == best(rows.values(), terms, 10), terms
    changed = {r[0]: r for r in some(rng, [*range(0, 60), *range(1000, 1020)])}
    P.update(index, spark.createDataFrame(list(changed.values()), SCHEMA), spark.createDataFrame([(i,) for i in (5, 70, 71, 9999)], "id long"))
    rows = {i: r for i, r in (rows | changed).items() if i not in (70, 71)}
    P.update(index, deleted=spark.createDataFrame([(0,), (1000,), (70,)], "id long"))
    rows = {i: r for i, r in rows.items() if i not in (0, 1000)}
    again = {r[0]: r for r in some(rng, [70, 1])}
    P.update(index, spark.createDataFrame(list(again.values()), SCHEMA))
    rows |= again
    whole = P.compact(index, f"file://{tmp_path}/b")
    for terms in QUERIES[1:3]:
        want = best(rows.values(), terms, 7)
        assert found(P.top(index, terms, 7)) == want
    assert found(P.top(whole, QUERIES[2], 7)) == want
    assert {r.id: round(r.bm25, 9) for r in P.scores(index, ["cat"]).collect()} == {i: round(s, 9) for i, s in plainly(rows.values(), ["cat"]).items()}
    assert index.last() == 3 and whole.last() == 0
    with pytest.raises(ValueError):
        P.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/a", FIELDS)


def test_levels_are_skipped(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "rare " * 5 if i < 30 else None, None, None, " ".join(rng.choices(["the", "a", "b", "c"], k=40)), None, None, 1) for i in range(600)]
    index = P.build(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/a", FIELDS)
    how = P.plan(index, ["rare", "the"], 10)
    assert not how.whole and set(how.finding) == {"rare"} and how.least > 0
    assert found(P.top(index, ["rare", "the"], 10)) == best(rows, ["rare", "the"], 10)
    pushed = index.read("postings").filter((F.col("bucket") == 3) & (F.col("term") == "the") & (F.col("level") >= 5))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in pushed and "EqualTo(term,the)" in pushed and "GreaterThanOrEqual(level,5)" in pushed


def test_odd_rows(spark, tmp_path):
    empty = P.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/a", FIELDS)
    assert P.top(empty, ["cat"], 5).count() == 0 and P.top(empty, [], 5).count() == 0
    P.update(empty, spark.createDataFrame([(1, "cat", *[None] * 5, 1), (1, "dog", *[None] * 5, 1), (2, *[None] * 6, 1), (3, "", "!!", None, None, None, None, 1)], SCHEMA))
    assert [r.id for r in P.top(empty, ["dog cat"], 5).collect()] == [1]
    assert empty.read("totals").agg(F.sum("n")).first()[0] == 3


def test_no_task_holds_a_whole_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "FILE_ROWS", 100)
    rows = [(i, "the " * (1 + i % 3), *[None] * 5, 1) for i in range(2000)]
    index = P.build(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/a", FIELDS)
    files = [r["count"] for r in index.read("postings").groupBy(F.input_file_name()).count().collect()]
    assert sum(files) == 2000 and max(files) <= 300


def test_tokens_are_counted_without_a_shuffle_of_their_own(spark):
    rows = [(1, "b a b", None, "a", None, None, "b"), (2, *[None] * 6)]
    made = P.forward(spark.createDataFrame(rows, SCHEMA.removesuffix(", other int")), FIELDS, search.BM25_FIELDS)
    assert {r.id: (r.length, sorted(map(tuple, r.terms)), r.alive) for r in made.collect()} == {1: (5, [("a", 3.0), ("b", 6.0)], True), 2: (0, [], True)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate [") == 1
