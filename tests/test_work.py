import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.streaming import events as E
from gleanery.streaming import work as W

T0 = datetime(2024, 1, 1)


def after(seconds):
    return T0 + timedelta(seconds=seconds)


def run(spark, tmp_path, batches, schema, build):
    """The rows of a stream over one file a batch."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/b{i:03d}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(source)
    query = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.recentProgress
    return spark.read.parquet(out), [sum(s.numRowsTotal for s in p.stateOperators) for p in progress]


RESULTS = "session string, query long, kind string, at timestamp, payload string"


def test_late_lexical_never_replaces_hybrid(spark, tmp_path):
    rng = random.Random(1)
    rows = [(s, q, k, after(rng.randrange(50)), f"{s}{q}{k}{i}") for s in "abc" for q in (1, 2, 3) for i, k in enumerate(("lexical", "hybrid", "lexical", "other")) if not (s == "b" and q == 3 and k == "hybrid")]
    rng.shuffle(rows)
    want = {r.session: (r.query, r.kind, r.payload) for r in W.current_results(spark.createDataFrame(rows + [(None, 1, "hybrid", T0, "x")], RESULTS)).collect()}
    assert {s: w[:2] for s, w in want.items()} == {"a": (3, "hybrid"), "b": (3, "lexical"), "c": (3, "hybrid")}
    shown, _ = run(spark, tmp_path, [rows[i : i + 7] for i in range(0, len(rows), 7)], RESULTS, lambda s: W.published_results(s, late="1 hour"))
    found = {}
    for r in shown.collect():
        merit = (r.query, W.KINDS[r.kind])
        found[r.session] = max(found.get(r.session, ((0, 0), None)), (merit, (r.query, r.kind)))
    assert {s: f[1] for s, f in found.items()} == {s: w[:2] for s, w in want.items()}
    assert {w[2] for w in want.values()} <= {r.payload for r in shown.collect()}


def test_state_of_quiet_sessions_goes(spark, tmp_path):
    batches = [[("a", 1, "hybrid", after(0), "x")], [("b", 1, "hybrid", after(4000), "y")], [("c", 1, "lexical", after(9000), "z")], [("c", 2, "lexical", after(9001), "w")]]
    shown, sizes = run(spark, tmp_path, batches, RESULTS, lambda s: W.published_results(s, 10, "1 second"))
    assert sorted((r.session, r.query) for r in shown.collect()) == [("a", 1), ("b", 1), ("c", 1), ("c", 2)]
    assert max(sizes) <= 8 and sizes[-1] < 3 * max(1, min(s for s in sizes if s))


EVENTS = "id long, item string, at timestamp, kind string, model string"


def ledger_rows():
    rng = random.Random(2)
    rows, t = [], 0
    for i in range(400):
        t += rng.randrange(1, 120)
        rows.append((i, rng.choice("pqrs"), after(t), rng.choice(["attempt"] * 5 + ["timeout", "timeout", "failed", "done", "cleared"]), rng.choice(["m1", "m2"])))
    return rows


def judged(rows, model="m1"):
    failed, until, out = {}, {}, []
    for i, item, at, kind, m in rows:
        if kind == "attempt":
            reason = "failed" if failed.get(item) == model else "timeout" if item in until and at < until[item] else None
            out.append((i, reason is None, reason))
        elif kind == "timeout":
            until[item] = at + timedelta(minutes=10)
        else:
            until.pop(item, None)
            failed[item] = m if kind == "failed" else None
    return sorted(out)


def test_ledger_batch_and_stream(spark, tmp_path):
    rows = ledger_rows()
    want = judged(rows)
    assert {r for _, _, r in want} == {None, "failed", "timeout"}
    mixed = rows[:]
    random.Random(3).shuffle(mixed)
    got = W.admitted(spark.createDataFrame(mixed, EVENTS), "m1").collect()
    assert sorted((r.id, r.admitted, r.reason) for r in got) == want
    shown, _ = run(spark, tmp_path, [rows[i : i + 80] for i in range(0, 400, 80)], EVENTS, lambda s: W.admitted_stream(s, "m1", late="1 second"))
    assert sorted((r.id, r.admitted, r.reason) for r in shown.collect()) == want


QUEUE = "id long, owner string, at timestamp, kind string, seconds double"


def queue_rows():
    rng = random.Random(4)
    rows, t = [], 0
    for i in range(600):
        t += rng.randrange(1, 30)
        rows.append((i, rng.choice("xyyy"), after(t), "start" if rng.random() < 0.06 else "item", rng.choice([None, 5.0, 60.0, 200.0])))
    return rows


def worked(rows, items, seconds):
    out, waiting = [], {}
    for i, owner, at, kind, cost in rows:
        queue = waiting.setdefault(owner, [])
        if kind == "item":
            queue.append((i, at, cost or 0))
            continue
        spent = n = 0
        while queue and n < items and spent < seconds:
            one = queue.pop(0)
            out.append((owner, i, n, one[0], one[1]))
            spent, n = spent + one[2], n + 1
    return sorted(out)


@pytest.mark.parametrize("items", [1, 12])
def test_sessions_batch_and_stream(spark, tmp_path, items):
    rows = queue_rows()
    want = worked(rows, items, 420)
    mixed = rows[:]
    random.Random(5).shuffle(mixed)
    assert sorted(map(tuple, W.sessions(spark.createDataFrame(mixed + [(900, None, T0, "item", 1.0)], QUEUE), items).collect())) == want
    if items > 1:
        shown, _ = run(spark, tmp_path, [rows[i : i + 150] for i in range(0, 600, 150)], QUEUE, lambda s: W.session_stream(s, items))
        assert sorted(map(tuple, shown.collect())) == want
        assert W.sessions(spark.createDataFrame([], QUEUE)).count() == 0


def test_throttle_lets_its_state_go(spark, tmp_path):
    rows = [[("k1", after(0)), ("k1", after(0.2)), ("k2", after(0.1))], [("k1", after(100)), ("k3", after(100.1))], [("k3", after(200)), ("k3", after(200.3))], [("k4", after(300))]]
    schema = "key string, ts timestamp"
    shown, sizes = run(spark, tmp_path, rows, schema, lambda s: E.throttle(s, "key", 500, late="1 second"))
    assert sorted((r.key, r.ts) for r in shown.collect()) == [("k1", after(0)), ("k1", after(100)), ("k2", after(0.1)), ("k3", after(100.1)), ("k3", after(200)), ("k4", after(300))]
    assert sizes[-1] <= 2
