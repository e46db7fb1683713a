import math
import random

from gleanery.operators import composing as C


def half(x):
    return math.floor(x + 0.5)


def unit(v):
    return round(min(1.0, max(0.0, v or 0.0)), 12)


def clamp(r):
    x, y = unit(r[0]), unit(r[1])
    return x, y, round(min(unit(r[2]), 1 - x), 12), round(min(unit(r[3]), 1 - y), 12)


def rect_at(keys, t):
    if not keys:
        return None
    if t <= keys[0][0]:
        return clamp(keys[0][1]), keys[0][3]
    if t >= keys[-1][0]:
        return clamp(keys[-1][1]), keys[-1][3]
    i = max(j for j, k in enumerate(keys) if k[0] <= t)
    a, b = keys[i], keys[i + 1]
    if a[2] == "hold":
        return clamp(a[1]), a[3]
    p = (t - a[0]) / (b[0] - a[0])
    return clamp([round(u + (v - u) * p, 12) for u, v in zip(a[1], b[1])]), a[3]


def test_rects_equal_brute_force(spark):
    rng = random.Random(1)
    points, corrections, active, want = [], [], [], {}
    for e in range(30):
        keys = {}
        for o in range(rng.randrange(7)):
            t, r, easing, mode = rng.randrange(0, 100), [rng.choice([rng.random() * 1.6 - 0.3, 0.0, None]) if rng.random() < 0.2 else rng.random() for _ in range(4)], rng.choice(["hold", "linear"]), rng.choice("ab")
            r = [v if v is not None else 0.0 for v in r]
            corrections.append((e, t, o, *r, easing, mode))
            keys[t] = (t, r, easing, mode)
        keys = [keys[t] for t in sorted(keys)]
        spans = [(a, a + rng.randrange(0, 30)) for a in rng.choices(range(100), k=rng.randrange(3))]
        active += [(e, *s) for s in spans]
        for t in {rng.randrange(-5, 105) for _ in range(25)} | {k[0] for k in keys} | {b for s in spans for b in s}:
            points.append((e, t))
            found = rect_at(keys, t) if not spans or any(a <= t <= b for a, b in spans) else None
            want[e, t] = (*found[0], found[1]) if found else (None,) * 5
    df = C.rects(spark.createDataFrame(points, "entity int, time_us long"), spark.createDataFrame(corrections, "entity int, time_us long, ordinal int, x double, y double, width double, height double, easing string, mode string"), spark.createDataFrame(active, "entity int, start_us long, end_us long"))
    got = {(r.entity, r.time_us): tuple(r)[2:] for r in df.collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert all(a == b if not isinstance(b, float) else abs(a - b) < 1e-9 for a, b in zip(got[k], w)), (k, got[k], w)


def plan(duration, speed, ranges, cards):
    """One project, step by step along the output."""
    if speed is None or not 0.5 <= speed <= 2:
        return [], [(None, "unsupported-speed")]
    merged = []
    for a, b in sorted((max(0, a), min(duration, b)) for a, b in ranges):
        if a >= b:
            continue
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    if not merged:
        return [], [(None, "no-retained-ranges")]
    kept = sum(b - a for a, b in merged)
    bad = []
    for o, uri, us, at in cards:
        kind = C.STILLS.get(uri.split("#")[0].split("?")[0].split("/")[-1].rpartition(".")[2].lower()) if "." in uri else None
        if kind is None:
            bad.append((o, "card-unsupported-asset"))
        elif not 200_000 <= us <= 10_000_000:
            bad.append((o, "card-duration-out-of-range"))
        elif not 0 <= at <= half(kept / speed):
            bad.append((o, "card-position-out-of-range"))
    if bad:
        return [], bad
    out, clock = [], 0

    def put(kind, length, *rest):
        nonlocal clock
        begin = half(clock / speed)
        clock += length
        out.append((len(out), kind, *rest, begin, half(clock / speed)))

    def where(at):
        before = 0
        for i, (a, b) in enumerate(merged):
            if i and at == half(before / speed):
                return before
            if at < half((before + b - a) / speed):
                return before + min(b - a, max(0, half(at * speed - before)))
            before += b - a
        return before

    line = sorted((where(at) if at > 0 else 0, at, o, uri, us) for o, uri, us, at in cards)
    before = 0
    for a, b in merged:
        cursor = a
        for p, at, o, uri, us in [c for c in line if before <= c[0] < before + b - a]:
            cut = a + p - before
            if cut > cursor:
                put("source", cut - cursor, cursor, cut, None)
                cursor = cut
            put("card", half(us / 1000) * 1000, None, None, o)
        put("source", b - cursor, cursor, b, None)
        before += b - a
    for p, at, o, uri, us in [c for c in line if c[0] >= before]:
        put("card", half(us / 1000) * 1000, None, None, o)
    return out, []


def test_compositions_equal_brute_force(spark):
    rng = random.Random(2)
    projects, ranges, cards, want, reasons = [], [], [], {}, {}
    for e in range(60):
        duration, speed = rng.randrange(0, 60) * 500_000, rng.choice([0.5, 1.0, 1.5, 2.0, 0.75, 3.0, None] if e % 9 == 0 else [0.5, 1.0, 1.5, 0.75])
        own = [(a, a + rng.randrange(0, 8_000_000)) for a in (rng.randrange(0, 30_000_000) for _ in range(rng.randrange(5)))]
        seams = [half((b - a) / (speed or 1)) for a, b in own[:1]]
        mine = [(o, rng.choice(["a/b.png", "x.JPG?q=1.gif", "c.heic#f.mp4"] if rng.random() < 0.9 else ["c.gif", "none", ""]), rng.randrange(200_000, 3_000_000) if rng.random() < 0.9 else 5, rng.choice([0, rng.randrange(0, 3_000_000), *seams])) for o in range(rng.randrange(4))]
        projects.append((e, duration, speed))
        ranges += [(e, *r) for r in own]
        cards += [(e, *c) for c in mine]
        want[e], reasons[e] = plan(duration, speed, own, mine)
    segments, rejected = C.compositions(spark.createDataFrame(projects, "entity int, duration_us long, speed double"), spark.createDataFrame(ranges, "entity int, start_us long, end_us long"), spark.createDataFrame(cards, "entity int, ordinal long, uri string, duration_us long, at_us long"))
    got = {e: [] for e in want}
    for r in segments.collect():
        got[r.entity].append((r["index"], r.kind, r.start_us, r.end_us, r.ordinal, r.output_start_us, r.output_end_us))
    assert {e: sorted(x) for e, x in got.items()} == want
    said = {e: [] for e in want}
    for r in rejected.collect():
        said[r.entity].append((r.ordinal, r.code))
    assert {e: sorted(x, key=str) for e, x in said.items()} == {e: sorted(x, key=str) for e, x in reasons.items()}
    assert sum(map(bool, want.values())) >= 15 and len({c for x in reasons.values() for _, c in x}) >= 4
    few, over = C.compositions(spark.createDataFrame([(1, 10, 1.0)], "entity int, duration_us long, speed double"), spark.createDataFrame([(1, 0, 3), (1, 5, 9)], "entity int, start_us long, end_us long"), spark.createDataFrame(cards[:0], "entity int, ordinal long, uri string, duration_us long, at_us long"), most=1)
    assert few.count() == 0 and [r.code for r in over.collect()] == ["segment-limit-exceeded"]
