import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F
from words import prose

from gleanery.llm import fingerprints as P


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def one(data, seed):
    return xxhash.xxh64_intdigest(data, seed)


def hashes(text, n=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    if len(words) < n:
        return {signed(one(" ".join(words).encode(), 42))} if words else set()
    own = [one(w.encode(), 42) for w in words]
    found = set()
    for i in range(len(own) - n + 1):
        h = 42
        for x in own[i : i + n]:
            h = one(struct.pack("<Q", x), h)
        found.add(signed(h))
    return found


def lowest(found, k):
    return sorted(found)[:k]


def likeness(a, b, k):
    if not a or not b:
        return float(not a and not b)
    u = lowest({*a, *b}, k)
    return len({*u} & {*a} & {*b}) / len(u)


def texts(rng):
    odd = ["", None, " \n\t ", "one", "Two words", "a b c d", "a b c d e", "a b c d e f", " É È ü 日本 語 x 😀 y ", "a\x0bb\x0cc\rd\te", "a a a a a a a a", "x" * 5000 + " a b c d"]
    return odd + [prose(rng, rng.randrange(1, 400)) for _ in range(60)] + [prose(rng, 4000)]


@pytest.mark.parametrize("stretch", [1_000_000, 7, 50])
def test_sketch_equals_brute_force(spark, stretch):
    rows = [(i, t) for i, t in enumerate(texts(random.Random(2))) if stretch > 10 or not t or len(t) < 2000]
    found = spark.createDataFrame(rows, "i int, text string").select("i", P.sketch(F.col("text"), 32, stretch=stretch).alias("s")).collect()
    assert {r.i: r.s for r in found} == {i: lowest(hashes(t), 32) for i, t in rows}


def plainly(rows, k):
    placed = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], signed(one((r[1] or "").encode(), 42)), r[1] or ""))
    pairs = [(a, placed[(i + 1) % len(placed)][1] or "") for i, a in enumerate(placed)] + [(r, "") for r in rows if r[0] is None]
    out = []
    for (doc_id, text), after in pairs:
        text = text or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        mine, theirs, nexts = (lowest(hashes(t), k) for t in (text, edited, after))
        digits = lambda s: "".join(f"{x & (1 << 64) - 1:016X}" for x in s)
        out.append((doc_id if doc_id is not None else -1, len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(mine), digits(theirs), likeness(mine, theirs, k), likeness(mine, nexts, k)))
    return sorted(out)


@pytest.mark.parametrize("sizes", [1, 2, 70])
def test_query_equals_brute_force(spark, tmp_path, sizes):
    rng = random.Random(3)
    rows = list(zip(rng.sample(range(10_000), 200), texts(rng)))[-sizes:] + ([(5, "twice"), (5, "twice"), (5, "thrice"), (None, "none at all here to see"), (None, None)] if sizes > 2 else [])
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = P.op13_bottom_k(spark, str(tmp_path)).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in found)
    assert got == plainly(rows, P.K)


def test_few_and_many_ranges(spark):
    rows = [(i * i, f"text {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 2, 7, 300):
        found = {r.doc_id: r.next_text for r in P.neighbours(df, n).collect()}
        assert found == {i * i: f"text {(i - 1) % 50}" for i in range(50)}


def test_parts_merge_and_estimates_hold(spark):
    rng = random.Random(4)
    shared, mine, theirs = prose(rng, 6000).split(), prose(rng, 3000).split(), prose(rng, 1000).split()
    a, b = " ".join(shared + mine), " ".join(shared + theirs)
    k, true_a, true_b = 256, hashes(" ".join(shared + mine)), hashes(" ".join(shared + theirs))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(P.sketch(F.col("a"), k).alias("a"), P.sketch(F.col("b"), k).alias("b"))
    r = df.select(P.resemblance(F.col("a"), F.col("b"), k).alias("j"), P.distinct_count(F.col("a"), k).alias("n"), P.containment(F.col("b"), F.col("a"), k).alias("c"), P.merged(F.col("a"), F.col("b"), k).alias("m")).first()
    assert abs(r.j - len(true_a & true_b) / len(true_a | true_b)) < 0.12
    assert abs(r.n / len(true_a) - 1) < 0.2
    assert abs(r.c - len(true_a & true_b) / len(true_b)) < 0.15
    assert r.m == lowest(true_a | true_b, k)
    parts = spark.createDataFrame([("x", sorted(rng.sample(range(10**6), 40))) for _ in range(50)] + [("y", []), ("y", None), ("z", [3, 1]), ("z", [1, 2])], "key string, s array<bigint>")
    merged = {r.key: r.s for r in P.merge_parts(parts, ["key"], "s", 64).collect()}
    assert merged == {"x": lowest({h for r in parts.filter("key = 'x'").collect() for h in r.s}, 64), "y": [], "z": [1, 2, 3]}


def test_strings_and_equal_texts(spark, odd_docs, no_docs):
    found = odd_docs.select("text", P.sketch(F.col("text")).alias("s")).select("text", "s", P.read_back(P.written_out(F.col("s"))).alias("t")).collect()
    assert all(r.s == r.t for r in found)
    assert len({r.text: tuple(r.s) for r in found}) == len({(r.text, tuple(r.s)) for r in found})
    assert P.with_edits(odd_docs).count() == odd_docs.count() and P.with_edits(no_docs).count() == 0
