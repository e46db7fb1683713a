import re
from collections import Counter, defaultdict

import pytest
from words import WORDS

from gleanery.llm import divergence as V

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = dict(zip(range(65, 91), range(97, 123)))


def plainly(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    holders, counts = Counter(), defaultdict(Counter)
    for lang, source, text in rows:
        terms = [t.translate(SMALL) for t in TERM.findall(text)]
        counts[lang, source].update(terms)
        holders.update((lang, t) for t in set(terms))
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for (x, t), n in holders.items() if x == lang and n >= min_docs]
        sources = {s for x, s, _ in rows if x == lang}

        def shares(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, value, rank + 1))
    return sorted(out)


def some(rng):
    rows = [(rng.choice(["en", "en", "de", None]), rng.choice("abcdefg"), " ".join(rng.choice(WORDS[: rng.choice((5, 30, 80))]).title() for _ in range(rng.randrange(40)))) for _ in range(220)]
    return rows + [("en", None, "ÄÖ Zürich, naïve_x2y éa"), ("one", "only", "bara bara"), ("none", "a", ""), ("none", "b", None), (None, None, None)] + [("en", "a", "same text twice")] * 5


@pytest.mark.parametrize("top", [2, 50])
def test_equals_brute_force(spark, rng, top):
    rows = some(rng)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, V.audit(docs, min_docs=4, top=top).collect())) == plainly(rows, 4, top)


def test_blocks_chunks_and_full_dictionaries(spark, rng, monkeypatch):
    rows = some(rng)
    monkeypatch.setattr(V, "ENTRIES", 50)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    kept = V.kept_terms(docs, 4)
    found = V.pair_values(kept, V.group_sizes(docs, kept), block=2, chunk=7).collect()
    assert sorted((r.lang, r.source, r.item, r.value) for r in found) == sorted((x, s, i, v) for x, s, part, i, v, _ in plainly(rows, 4, 1) if part == "pair")


def test_large_counts():
    import numpy as np

    c, n, v = 5 * 10**12, 9 * 10**13, 10**6
    assert V._shares(np.array([c, 0]), np.array([n, n]), v).tolist() == [1 + 10**9 * (x + 5) // (n + 5 * v) for x in (c, 0)]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, V.audit(odd_docs, min_docs=2).collect())) == plainly(rows, 2, 50)
    assert V.audit(no_docs).count() == 0
