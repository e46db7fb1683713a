import random
import time

import numpy as np
import pytest
from words import prose

from gleanery.llm import decontaminate as D


def form(text):
    return bytes(D.normal([text])[0][1:-1]).decode(errors="replace").strip()


def distance(item, text):
    """Least edits of item inside text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def brute(items, text):
    t = D.normal([text])[0][1:-1].tobytes()
    out = set()
    for k, item in items:
        f = D.normal([item or ""])[0][1:-1].tobytes().rstrip(b" ")
        if len(f) >= D.LEAST and t:
            w, edits, _ = D.budget(len(f))
            if len(f) < D.SHORT:
                if b" " + f + b" " in b" " + t + b" ":
                    out.add(k)
                continue
            if any(distance(f[s : s + w], t) <= edits for s in range(len(f) - w + 1)):
                out.add(k)
    return out


def test_form():
    assert form("  Ab--C,\n1  é!") == "ab c 1 é"
    assert D.normal(["a", "", " b "])[0].tobytes() == b"\x00a\x00\x00b \x00"


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        i = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[i] = "q"
        elif kind == 1:
            chars.insert(i, "z")
        else:
            del chars[i]
    return "".join(chars)


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice((3, 5, 9, 16, 30)))) for i in range(6)] + [(90, None), (91, ""), (92, "short one")]
    index = D.make_index(items)
    texts = ["", "x", prose(rng, 60)]
    for k in range(14):
        item = rng.choice(items[:6])[1]
        piece = item if k % 2 else item[len(item) // 4 :]
        texts.append(prose(rng, 10) + " " + edited(rng, piece, rng.choice((0, 1, 2, 4, 7, 12))).upper() + "! " + prose(rng, 10))
    found = {}
    for x, y, edits, start, length in D.leaks(index, texts):
        found.setdefault(x, set()).add(index.ids[y])
        f = index.forms[y][start : start + length].tobytes()
        assert distance(f, D.normal([texts[x]])[0][1:-1].tobytes()) <= edits <= D.budget(len(index.forms[y]))[1]
    for i, t in enumerate(texts):
        assert found.get(i, set()) == brute(items, t)


def test_frames(spark, rng, odd_docs, no_docs, monkeypatch):
    items = spark.createDataFrame([(1, prose(rng, 30)), (2, None), (3, prose(rng, 30)), (None, prose(rng, 30))], "item_id long, text string")
    texts = {r.item_id: r.text for r in items.collect()}
    rows = [(1, "a " + texts[1]), (1, "a " + texts[1]), (2, "clean"), (None, texts[3]), (5, texts[None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as item_id")
    wanted = sorted([(1, 1), (1, 1), (None, 3), (5, None)], key=str)
    assert sorted([(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()], key=str) == wanted
    kept = D.drop_leaked(docs, items)
    assert kept.collect() == [(2, "clean", "c")] and kept.columns == docs.columns
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)  # several passes
    assert sorted([(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()], key=str) == wanted
    assert D.drop_leaked(docs, items).count() == 1
    assert D.find_leaks(no_docs, items).count() == 0 and D.find_leaks(odd_docs, items.limit(0)).count() == 0
    assert D.drop_leaked(odd_docs, items).exceptAll(odd_docs).count() == 0 and D.drop_leaked(odd_docs, items).count() == odd_docs.count()


def test_band_walls():
    item = np.frombuffer(b"abcdefghij" * 8, np.uint8)
    text = np.frombuffer(b"xx" + b"abcdefghij" * 8, np.uint8)

    def edits(high, place, width):
        one = lambda x: np.array([x])
        return D.align(item, one(0), one(80), text, one(place), one(0), one(high), width, 9).tolist()

    assert edits(82, 0, 5) == [0] and edits(79, -3, 8) == [3] and edits(60, 0, 5) == [10]


def test_short_items(spark):
    index = D.make_index([(1, "Who wrote Don Quixote?"), (2, "too short"), (3, "twelve bytes"), (4, "x" * 23)])
    assert index.ids == [1, 3, 4]
    texts = ["who wrote, don quixote", "a Who wrote Don Quixote? b", "who wrote don quixotes", "xwho wrote don quixote", "who wrote don quixot", "twelve bytes", "x" * 24, "x" * 23 + "."]
    assert [(x, index.ids[y], e) for x, y, e, *_ in D.leaks(index, texts)] == [(0, 1, 0), (1, 1, 0), (5, 3, 0), (7, 4, 0)]


def test_parts_of_counts_change_nothing(monkeypatch):
    rng = random.Random(5)
    items = [(i, "what is the capital of the country of " + prose(rng, 12)) for i in range(40)] + [(90, "ab" * 300)]
    index = D.make_index(items)
    texts = [" ".join(rng.choice(items)[1] if rng.random() < 0.3 else prose(rng, 20) for _ in range(30)), "ab" * 2000, "what is the capital of the country of x " * 50]
    whole = D.leaks(index, texts)
    monkeypatch.setattr(D, "MATCHES", 3000)
    monkeypatch.setattr(D, "ALIGNED", 500)
    assert D.leaks(index, texts) == whole and {index.ids[y] for x, y, *_ in whole if x == 1} == {90}


def test_templated_items_are_quick():
    rng = random.Random(6)
    stem = "According to the passage above, which of the following is correct"
    index = D.make_index([(i, f"{stem} {rng.getrandbits(300):x} {rng.getrandbits(300):x}") for i in range(3000)])
    text = " ".join(stem + " " + prose(rng, 6) for _ in range(10))
    began = time.process_time()
    assert D.leaks(index, [text]) == []
    assert time.process_time() - began < 8  # linear in items and repeats; about a second where nothing else runs


def test_items_that_share_a_leaked_stem_are_quick():
    rng = random.Random(7)
    stem = prose(rng, 60)[:174].strip()
    items = [(i, f"{stem} {rng.getrandbits(300):x} {rng.getrandbits(300):x}") for i in range(3000)]
    index = D.make_index(items)
    for repeats in (1, 10):
        text = " ".join(f"{stem} {prose(rng, 25)}" for _ in range(repeats))
        began = time.process_time()
        found = D.leaks(index, [text])
        assert time.process_time() - began < 6  # under 3 s where nothing else runs
        assert {(y, edits) for _, y, edits, _, _ in found} == {(i, 0) for i in range(3000)}
    some = D.make_index(items[:40])
    noisy = " ".join(stem[:50] + "x" + stem[51:100] + stem[101:] + " " + prose(rng, 9) for _ in range(3))
    assert D.leaks(some, [noisy, text]) == [(x, y, *rest) for x in (0, 1) for y in range(40) for _, _, *rest in D.leaks(D.make_index([items[y]]), [(noisy, text)[x]])]
