import numpy as np
import pytest

from gleanery.llm import ann


def brute(rows, query_ids, k):
    out = {}
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    for q in query_ids:
        s = x @ x[list(ids).index(q)]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def vectors():
    x = np.random.default_rng(1).normal(size=(3000, 32)).astype(np.float32)
    x[:1500] /= np.linalg.norm(x[:1500], axis=1, keepdims=True)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_recall_over_shards(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "'x' as shard", "1 as ids")
    index = ann.build_index(df, shard_rows=1000)
    assert index.count() >= 3
    rows = found(ann.search(index, df.filter("vec_id % 20 = 0"), query_rows=64))
    wanted = brute(vectors, range(0, 3000, 20), 20)
    assert set(rows) == set(wanted)
    share = np.mean([len({a for a, _ in rows[q]} & {a for a, _ in wanted[q]}) / 20 for q in wanted])
    assert share >= 0.9
    for q, own in rows.items():
        exact = dict(brute(vectors, [q], 3000)[q])
        assert all(abs(s - exact[v]) < 1e-9 for v, s in own)
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))


NORMS = {"unit": 0.0, "near": 0.25, "uneven": 0.5, "wide": 1.0, "very_wide": 2.0, "one_long": None}


@pytest.mark.parametrize("norms", NORMS)
def test_recall_where_norms_differ(spark, norms):
    """Shards of up to 5,000 vectors of 64 dimensions; one vector may be 10,000 times as long as the others."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.where(np.arange(5000) == 77, 1e4, 1.0)[:, None] if NORMS[norms] is None else np.exp(rng.normal(size=5000) * NORMS[norms])[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, wanted = found(ann.search(ann.build_index(df), df.filter("vec_id % 50 = 0"))), brute(rows, range(0, 5000, 50), 20)
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in wanted[q]}) / 20 for q in wanted]) >= 0.9


def test_huge_and_tiny_norms(spark):
    rows = [(i, [s * 10.0**e, 1.0 * 10.0**e]) for i, (s, e) in enumerate([(1, 300), (-1, 300), (1, -300), (-1, -300), (2, 0), (-3, 0)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.search(ann.build_index(df), df))
    assert {q: len(r) for q, r in got.items()} == {i: 5 for i in range(6)}
    assert [v for v, _ in got[4]][:3] == [0, 2, 3] or [v for v, _ in got[4]][0] == 0


def test_all_candidates_if_few(spark, vectors):
    few = vectors[:15]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    rows = found(ann.search(ann.build_index(df), df))
    wanted = brute(few, range(15), 20)
    assert {q: [v for v, _ in r] for q, r in rows.items()} == {q: [v for v, _ in r] for q, r in wanted.items()}


def test_copies_and_unusable_rows(spark):
    one, two = [1.0, 0.0, 0.0], [0.9, 0.1, 0.0]
    rows = [(i, one) for i in range(60)] + [(100, two), (101, None), (102, [0.0, 0.0, 0.0]), (103, [float("nan"), 1.0, 0.0]), (104, [None, 1.0, 0.0]), (105, []), (106, [float("inf"), 0.0, 0.0]), (None, one), (107, [1.0, 0.0]), (7, one)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = found(ann.search(ann.build_index(df, k=5), df.filter("vec_id in (0, 7, 100, 101, 102, 103, 107)"), k=5))
    assert {q: [v for v, _ in r] for q, r in out.items()} == {0: [1, 2, 3, 4, 5], 7: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4]}
    few = [(1, one), (1, two), (1, two), (2, one)]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    # The least vector asks; its other rows are candidates.
    assert [v for v, _ in found(ann.search(ann.build_index(df), df.filter("vec_id = 1")))[1]] == [1, 2, 1]
    assert ann.search(ann.build_index(df.limit(0)), df.limit(0)).count() == 0


def test_double_precision_and_extreme_values(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    x[:40] *= 1e150
    x[40:80] *= 1e-60
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = found(ann.search(ann.build_index(df), df, query_rows=64))
    wanted = brute(rows, range(300), 20)
    assert set(out) == set(range(300))
    assert all(abs(s - t) <= 1e-12 * abs(t) for q in out for (_, s), (_, t) in zip(out[q], wanted[q]))
    big = spark.createDataFrame([(1, [1e300, 1.0]), (2, [1.0, 1.0]), (3, [1e-60, 0.0])], "vec_id long, embedding array<double>")
    assert {q: [v for v, _ in r] for q, r in found(ann.search(ann.build_index(big), big)).items()} == {1: [2, 3], 2: [1, 3], 3: [1, 2]}


def test_every_node_is_reached():
    x = np.concatenate([np.tile(np.eye(8, dtype=np.float32)[i], (50, 1)) + np.random.default_rng(i).normal(0, 1e-3, (50, 8)).astype(np.float32) for i in range(8)])
    graph = ann.Graph.build(x)
    near = graph.search(x[:3], ef=400)
    assert (np.sort(near, axis=1) == np.arange(400)).all()
