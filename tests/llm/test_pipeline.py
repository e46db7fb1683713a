import os
import random
from collections import Counter

import corpus_pipeline as P
from test_classifiers import say
from test_packing_and_counts import plain_ids
from words import prose

from gleanery.llm import registry


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    items = [(i, prose(rng, 30)) for i in range(3)]
    base = [(i, say(rng, "ab"[i % 2] * 2, 60), "ab"[i % 2] * 2, "s", None) for i in range(60)]
    extra = [
        (100, base[0][1] + " tail", "aa", "s", 1), (101, base[0][1], "aa", "s", 1), (102, say(rng, "aa", 50) + " " + items[1][1] + " " + say(rng, "aa", 50), "aa", "s", 1),
        (103, "12 34", "aa", "s", 5), (104, None, "aa", "s", 0), (105, say(rng, "bb", 80) + " password = hunter22x", "bb", "s", 9),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(base + extra, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == {*range(60), 105}
    assert kept[105].endswith("[SECRET]") and all(kept[i] == base[i][1] for i in range(60))
    rows = P.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in rows).keys() == kept.keys()
    for i in (0, 105):
        assert [t for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start) for t in r.ids] == [*plain_ids(kept[i]), 0]


def shingles(text, words=5):
    w = text.split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def test_near_copies_from_080(spark, tmp_path):
    rng = random.Random(9)
    one, two, three = ([f"{c}{i:03d}" for i in rng.sample(range(1000), 94)] for c in "xyz")
    rows = [(1, one), (2, one + [f"tail{i}" for i in range(18)]), (3, two), (4, [w if i not in (23, 70) else f"new{i}" for i, w in enumerate(two)]), (5, three), (6, three + [f"more{i}" for i in range(30)])]
    rows = [(i, " ".join(w)) for i, w in rows]
    sets = {i: shingles(t) for i, t in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in ((1, 2), (3, 4), (5, 6))}
    assert 0.8 <= alike[1, 2] < 0.85 and 0.8 <= alike[3, 4] < 0.85 and alike[5, 6] < 0.8
    docs = spark.createDataFrame([(i, t, "aa", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in dict(P.STAGES)["near_copies"](spark, docs, str(tmp_path)).collect()} == {1, 3, 5, 6}


#: Names that the operators use inside, as a user's own columns.
NAMES = "_hash _h _id _spans _text_hash _doc_id _n component_id root set_a keys map held_out lang_pred score spans found item_id edits length ids sequence_id node key one two side label blocks".split()


def test_stages_on_odd_rows_and_clashing_names(spark, tmp_path):
    rng = random.Random(10)
    item = prose(rng, 30)
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = [(i, say(rng, "ab"[i % 2] * 2, 50), "ab"[i % 2] * 2) for i in range(30)]
    long = say(rng, "aa", 60_000)
    odd = [(100, None, "aa"), (101, "", None), (None, plain[0][1], "aa"), (None, say(rng, "aa", 50), None), (plain[1][0], plain[1][1], "bb"), (102, long, "aa"), (None, None, None), (103, f"{say(rng, 'aa', 30)} {item}", "aa"), (104, f"{say(rng, 'bb', 60)} password = hunter22x", "bb")]
    docs = spark.createDataFrame([(*r, "s", None) for r in plain + odd], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"{k} as `{n}`" for k, n in enumerate(NAMES)])
    stages = dict(P.STAGES)
    left = {}
    for name in ("language", "near_copies", "benchmark", "secrets"):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r[n] == k for r in rows for k, n in enumerate(NAMES))
        left[name] = Counter((r.doc_id, r.text) for r in rows)
    every = Counter((r[0], r[1]) for r in plain + odd)
    empty = Counter({(100, None): 1, (101, ""): 1, (None, None): 1})
    assert left["language"] == every - empty
    assert left["near_copies"] == every - Counter({(None, plain[0][1]): 1, (plain[1][0], plain[1][1]): 1})
    assert every - left["benchmark"] == Counter({(103, odd[7][1]): 1}) and sum(left["benchmark"].values()) == len(plain + odd) - 1
    assert every - left["secrets"] == Counter({(104, odd[8][1]): 1}) and (104, odd[8][1].replace("password = hunter22x", "[SECRET]")) in left["secrets"]
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert sum(r.length for r in packed if r.doc_id == 102) == len(plain_ids(long)) + 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(registry.QUERIES) <= set(names) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
    assert not [f for f in os.listdir(os.path.dirname(P.__file__)) if f.endswith(".parquet")]
