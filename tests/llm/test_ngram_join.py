import random
from collections import defaultdict

import numpy as np
import pytest
from words import prose

from gleanery.llm import components, ngram_join, textvec


ALL = 1 << 64


def shingles(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in low).split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, percent=85, words=4):
    """doc_id -> component over all pairs of rows."""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = d if least[r] is None else min(d, least[r])
    return sorted(((d, len(s), d if not s else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def corpus(rng):
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    passage = prose(rng, 30)
    for size in (1, 3, 4, 6, 8, 9, 10, 12, 20, 60, 200):
        for _ in range(3):
            base = prose(rng, size).split()
            add(" ".join(base))
            add(" ".join(base).upper())
            for edits in (1, 2, 3, 5, 9):
                words = list(base)
                for _ in range(edits):
                    words.insert(rng.randrange(len(words) + 1), "new%d" % rng.randrange(10**6))
                add("\n".join(words))
                add(" ".join(base[: max(1, len(base) - edits)]))
    for _ in range(60):
        add(passage + " " + prose(rng, rng.choice((2, 5, 40))))
    chain = prose(rng, 100).split()
    for i in range(40):
        add(" ".join(chain[i : i + 60]))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "x" * 5000), (n + 3, "x" * 5000), (None, rows[0][1])]
    n += 4
    # A row without a doc_id links two others, and several share one; a doc_id stands for two texts; long near copies; many near copies of one text.
    bridge = prose(rng, 100).split()
    rows += [(n, " ".join(bridge[:90])), (None, " ".join(bridge[4:94])), (None, " ".join(bridge[4:94])), (n + 1, " ".join(bridge[8:98]))]
    rows += [(n + 2, prose(rng, 30)), (n + 2, " ".join(bridge[2:90])), (n + 2, " ".join(bridge[2:90])), (None, prose(rng, 40)), (None, None)]
    n += 3
    long = prose(rng, 30_000).split()
    rows += [(n, " ".join(long)), (n + 1, " ".join(long[:27_000])), (None, " ".join(long[:27_500] + ["x"]))]
    n += 2
    hot = prose(rng, 80).split()
    for i in range(90):
        own = list(hot)
        for k in range(rng.randrange(4)):
            own[rng.randrange(80)] = f"own{i}k{k}"
        rows.append((n + i if i % 9 else None, " ".join(own)))
    return rows


@pytest.mark.parametrize("block", [2048, 12])
def test_components_equal_brute_force(spark, rng, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # small blocks: groups and keys span several
    rows = corpus(rng)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'k' as key", "2 as _h", "3 as component_id")
    assert found(ngram_join.near_duplicates(docs)) == brute(rows)


def test_components_at_other_thresholds(spark, rng):
    rows = corpus(rng)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(ngram_join.near_duplicates(docs, 5, 80)) == brute(rows, 80, 5)


def test_empty(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(4)
    stop = np.zeros(0, np.uint64)
    for trial in range(4000):
        n = int(rng.integers(6, 90))
        base = np.unique(rng.integers(0, ALL, n, dtype=np.uint64))
        more = rng.integers(0, ALL, int(rng.integers(0, 1 + n // 6)), dtype=np.uint64)
        other = np.unique(np.concatenate([base[int(rng.integers(0, 1 + n // 8)) :], more]))
        both = len(np.intersect1d(base, other))
        if trial % 3 == 0:
            stop = np.sort(rng.choice(base, len(base) * 2 // 3, replace=False))
        if not np.array_equal(base, other) and 100 * both >= 85 * (len(base) + len(other) - both):
            keys = [set(ngram_join.candidate_keys(s, stop).tolist()) for s in (base, other)]
            assert keys[0] & keys[1]


def test_trees_find_all_links():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, ALL, int(rng.integers(1, 120)), dtype=np.uint64))
        sets += [base[rng.random(len(base)) > cut] for cut in (0, 0.02, 0.05, 0.1, 0.2)]
    sets = [s for s in sets if len(s)]

    def groups(pairs):
        root = list(range(len(sets)))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
        return {frozenset(k for k in range(len(sets)) if root[k] == r) for r in root}

    true = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - b)]
    assert groups(ngram_join.linked_pairs(sets, None)) == groups(true)
    maps = [ngram_join.token_map(s, ngram_join.bits_of(len(s))).tobytes() for s in sets]
    possible = groups(ngram_join.possible_pairs([[len(s) for s in sets]], [maps]))
    assert all(any(g <= p for p in possible) for g in groups(true))
    for i, j in true:
        assert ngram_join._pair_possible(len(sets[i]), maps[i], len(sets[j]), maps[j], 85)


def test_hashes_of_stretches(monkeypatch):
    text = "Ab cd\tef  gh é " * 50
    whole = textvec.word_hashes([text, "x", ""])
    monkeypatch.setattr(textvec, "STRETCH", 20)
    cut = textvec.word_hashes([text, "x", ""])
    assert (whole[0] == cut[0]).all() and whole[1].tolist() == cut[1].tolist() == [0, 250, 251, 251]


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300) if i % 10] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)] + [(5, 5)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {r.node: r.root for r in rows}
    assert len(root) == len(rows)
    assert all(root[a] == root[b] for a, b in edges if a != b)
    assert {root[i] for i in range(1, 11)} == {root[1]} and len({root[i] for i in range(1, 300)}) == 30
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark, rng):
    text, other, alone = prose(rng, 50), prose(rng, 50), prose(rng, 50)
    rows = [(3, text, "a"), (1, text + " more", "b"), (2, other, "c"), (2, other, "c"), (2, text, "d"), (7, None, "e"), (None, text, "f"), (8, "", None), (None, alone, "g"), (None, alone, "g"), (None, None, "h"), (None, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").selectExpr("*", "9 as _text_hash", "9 as _doc_id", "9 as _Hash", "9 as _n", "9 as root", "9 as component_id")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[:3] for r in kept.collect()), key=str) == sorted([rows[i] for i in (1, 2, 5, 7, 8, 10, 11)], key=str)
    assert ngram_join.keep_one(docs.limit(0)).count() == 0
