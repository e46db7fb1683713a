import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm import fill_middle as M

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(a), len(m), f"<P>{a}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{a}<M>{m}"


def texts(rng):
    bits = ["a", "wort", "é", "日本", "😀", "<", "<P", "<S", "P>", ">", "<<M", "S", " ", "\t\n", "\x0b", "\x0c", "\r", "\x85", " ", "\x00", "\x1c"]
    for _ in range(1500):
        yield "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))
    for mark in ("<P>", "<S>", "<M>"):
        yield f"one {mark} two"
        yield f"one <{mark}>"
        yield " " * 254 + mark + "x"
    yield "long wört 😀\n" * 60_000
    yield "x" * 300_000
    yield " \n" * 700


def test_equals_brute_force(spark, rng):
    rows = [(i, t) for i, t in enumerate(texts(rng))]
    found = M.transform(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("back", M.restore(F.col("output"), F.col("form")).cast("string")).collect()
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found}
    assert got == {i: plainly(i, t) for i, t in rows}
    assert {r.doc_id: r.back for r in found} == dict(rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_lanes_and_texts_side_by_side(rng):
    """Characters, sentinels and blanks across the edges of lanes and texts."""
    found = [t.encode() for t in texts(random.Random(1))][:700] + ["é".encode() * 200, b"", b"<P", b"> <M>", b" ", b""]
    ends = np.cumsum([len(t) for t in found])
    cuts = M.cut_points(np.frombuffer(b"".join(found), np.uint8), ends, list(range(len(found))))
    for i, (t, cut) in enumerate(zip(found, cuts)):
        n, form, prefix, middle, _ = plainly(i, t.decode())
        assert (cut[0], cut[1], cut[4], cut[5]) == (n, form, prefix, middle)
        if form != "plain":
            assert len(t[: cut[2]].decode()) == prefix and len(t[cut[2] : cut[3]].decode()) == middle


def test_bytes_that_are_not_utf8(spark):
    raw = [b"\x80\x80 a", b"a\xe2\x82 b\xff", b"\xf0\x9f\x98 \xe4", b"<\x80P>", b"ok " * 9 + b"\xc3"]
    df = spark.createDataFrame([(i, bytearray(b)) for i in range(8) for b in raw], "doc_id long, raw binary").withColumn("text", F.col("raw").cast("string"))
    for r in M.transform(df).select("doc_id", "form", "n", M.restore(F.col("output"), F.col("form")).alias("back")).collect():
        assert bytes(r.back) in raw


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output) for r in M.transform(odd_docs).collect())
    want = []
    for r in odd_docs.collect():
        n, form, a, m, out = plainly(r.doc_id, r.text)
        want.append((r.doc_id if r.doc_id is not None else -1, n, form, a or 0, m or 0, out))
    assert got == sorted(want)
    assert M.transform(no_docs).count() == 0
