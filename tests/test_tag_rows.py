"""Tags of owners with any number of events: the queries against plain Python over the whole table, and rows against arrays."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleanery.functions import tags as T
from gleanery.operators import evaluate, merge
from gleanery.plans import catalog

SOURCES = ("manual", "exemplar", "propagated", "ocr", "vision", "prompt", None)
RANK = {"manual": 6, "exemplar": 5, "propagated": 4, "ocr": 3, "vision": 2}
FACETS = {"click": "action", "view": "action", "error": "emotion", "signup": "topic"}


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """One owner has 900 of 1,000 events; what only later events say is in the tail."""
    d = str(tmp_path_factory.mktemp("events"))
    names = ("click", "view", "purchase", "signup")
    rows = [(i, 1 if i % 10 else 2 + i % 3, names[i % 3] if i < 700 else names[i % 4], float((i * 37) % 250)) for i in range(1000)] + [(1000, 1, "error", 499.0)]
    rows += [(2000 + 7 * i + 5, 9, "click", 0.0) for i in range(60)] + [(3003, 9, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{d}/events.parquet")
    owners = defaultdict(list)
    for i, owner, label, value in sorted(rows):
        owners[owner].append((label, round(value / 500, 4), SOURCES[i % 7]))
    return d, owners


def rows_of(spark, name, d, *columns):
    return sorted((tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, d).collect()), key=str)


def test_queries_take_every_tag(spark, events):
    d, owners = events
    tiers, firsts, merged, asserted, facets = [], [], [], defaultdict(lambda: [0, 0]), defaultdict(set)
    for owner, tags in owners.items():
        best = max((s for _, s, src in tags if src != "vision"), default=0)
        tiers.append((owner, "recognized" if best >= 0.56 or any(src in ("manual", "ocr", "exemplar", "propagated") for *_, src in tags) else "weak" if best > 0 else "unknown"))
        first = {}
        for i, (label, score, _) in enumerate(tags):
            first.setdefault(label, (i, score))
        firsts += [(owner, label, score) for label, (_, score) in first.items()]
        top = {label: max((RANK.get(src, 1), s, i, src) for i, (x, s, src) in enumerate(tags) if x == label) for label in first}
        order = sorted(top, key=lambda x: (top[x][0] < 4, -top[x][0], -top[x][1], first[x][0]))
        durable = [x for x in order if top[x][0] >= 4]
        merged += [(owner, pos, x, top[x][3], top[x][1]) for pos, x in enumerate(durable + order[len(durable) :][:2])]
        for label, _, src in tags:
            if src == "manual":
                asserted[label][0] += 1
                asserted[label][1] += any(src2 != "manual" and label in x for x, _, src2 in tags)
            if label in FACETS:
                facets[FACETS[label]].add(owner)
    assert rows_of(spark, "recognition_tier", d, "owner", "tier") == sorted(tiers, key=str)
    assert rows_of(spark, "tag_normalize", d, "owner", "label", "score") == sorted(firsts, key=str)
    assert rows_of(spark, "tag_merge", d, "owner", "pos", "label", "source", "score") == sorted(merged, key=str)
    assert rows_of(spark, "tag_agreement", d, "label", "asserted", "agreed") == sorted(((x, *n) for x, n in asserted.items()), key=str)
    assert rows_of(spark, "facet_coverage", d, "facet", "items", "share") == sorted(((f, len(o), round(len(o) / len(owners), 6)) for f, o in facets.items()), key=str)


def test_rows_equal_arrays(spark):
    tags = [(o, i, ("Cat ", "cat", "dog", " ", "catfish", "a b")[i * 7 % 6], (i * 13 % 10) / 10, SOURCES[(i * 5 + o) % 7]) for o in range(6) for i in range(3 * o + 1)]
    rows = spark.createDataFrame(tags, "owner long, id long, label string, score double, source string")
    tag = F.struct("id", F.struct("label", F.lit("topic").alias("category"), "score", "source").alias("t"))
    lists = rows.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(tag)), lambda x: x["t"]).cast(T.TAGS).alias("tags"))
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert same(merge.tag_tiers(rows), lists.select("owner", T.recognition_tier("tags")))
    assert same(merge.first_tags(rows), lists.select("owner", F.explode(T.normalize("tags")).alias("t")).select("owner", "t.label", "t.score"))
    assert same(merge.merged_tags(rows, 1), lists.select("owner", F.posexplode(T.merge_durable("tags", 1)).alias("pos", "t")).select("owner", "pos", "t.label", "t.source", "t.score"))
    assert same(evaluate.agreement_rows(rows), evaluate.agreement(lists.select(F.lit("").alias("caption"), "tags")))
