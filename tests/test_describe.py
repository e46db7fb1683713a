import json
import random
import re

from pyspark.sql import functions as F

from gleanery.functions import replies as R
from gleanery.operators import describe as D


def junk(s):
    s = s.strip()
    return not s or bool(re.fullmatch(r"<.*>", s)) or any(h in s.lower() for h in R.HINTS)


def clean(s):
    v = re.sub(r"^[\s\"'`*\[\]]+|[\s\"'`*\[\]]+$", "", s)
    return "" if junk(v) else v


def parts(s):
    return [] if junk(s) else [v for v in map(clean, re.split(r"[,;\n]+", s)) if v][:16]


def unquote(s):
    try:
        return json.loads(f'"{s}"').strip()
    except ValueError:
        return None


def plainly(raw):
    reply = (raw or "").strip()
    out, current = {}, None
    for line in re.split(r"\r?\n", reply):
        if re.match(r"\s*```", line):
            continue
        m = re.match(r"\s*(caption|subjects|text|tags)\s*[:\-]\s*(.*)$", line, re.IGNORECASE)
        if m:
            current = m[1].lower()
            out[current] = f"{out.get(current, '')} {m[2].strip()}".strip()
        elif current and line.strip():
            out[current] = f"{out[current]} {line.strip()}".strip()
    if current:
        return clean(out.get("caption", "")), parts(out.get("subjects", "")), clean(out.get("text", "")), parts(out.get("tags", ""))
    begin, end, tree = reply.find("{"), reply.rfind("}"), {}
    if 0 <= begin < end:
        try:
            tree = json.loads(reply[begin : end + 1])
        except ValueError:
            tree = {}

    def string(name):
        v = tree.get(name)
        if isinstance(v, str) and not junk(v):
            return v.strip()
        m = re.search(rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"', reply)
        v = unquote(m[1]) if m else None
        return v if v and not junk(v) else None

    def array(name):
        if name in tree:
            return [str(v).strip() for v in tree[name] if not junk(str(v))][:16] if isinstance(tree[name], list) else []
        m = re.search(rf'"{name}"\s*:\s*\[([^\]]*)', reply)
        found = [unquote(v) for v in re.findall(r'"((?:[^"\\]|\\.)*)"', m[1])] if m else []
        return [v for v in found if v and not junk(v)][:16]

    bare = reply
    if begin >= 0 or re.search('"(?:caption|subjects|text|tags)"', reply):
        for p, f in ((r"<[^>]*>", 0), (r'"(?:caption|subjects|text|tags)"\s*:', re.IGNORECASE), (r'[{}\[\]"]', 0), (r"[,:]+", 0)):
            bare = re.sub(p, " ", bare, flags=f)
    caption = string("caption") or re.sub(r"\s+", " ", bare).strip()[:240]
    return caption, array("subjects"), string("text") or "", array("tags")


REPLIES = [
    None, "", "   ", "just a picture of   a cat\non a mat", "x" * 500,
    "CAPTION: a dog sips coffee\nTEXT: this is fine\nSUBJECTS: dog, fire\nTAGS: this is fine, denial; calm",
    "```\ncaption - wrapped\n  over lines\n\nTags: \"a\", *b*, [c],, ;d\n```\nsubjects: main people, characters, or objects\ntext:",
    "Caption: one\ncaption: two\ncaption:\nthree\r\nTEXT: '`quoted`'", "tags: " + ",".join(f"t{i}" for i in range(30)), "CAPTION: <one short line>\nTEXT: leave blank if none\nTAGS: comma-separated",
    '{"caption": "whole", "subjects": ["a", "<b>", " c "], "text": "t\\n\\"q\\"", "tags": ["x", 5, true]}', 'Sure! {"caption": "in prose", "tags": []} hope it helps',
    '{"caption": "cut", "subjects": ["a", "b\\u0041", "c', '{"caption": "broken \\" quote", "subjects": ["a" "b"], "text": "kept", "tags": ["x",]}', '{"caption": "<caption>", "text": 7, "subjects": "no list", "tags": {"a": 1}}',
    '{"subjects": ["only"], "tags": ["lowercase keywords"]', '"tags": ["no", "braces"], "caption" : "loose"', '{"Caption": "wrong case", "x": [1, {"y": "z"}]}', "{", "}", "{}", '{"caption": ""}', '{"caption": "a\nraw line"}',
    '{"caption": "' + "long \\n" * 3000 + '", "tags": ["' + '", "'.join("y" * 10 for _ in range(40)) + '"]', "text mentions caption: inside\nand a caption", "{not json} at all: [a, b], c",
]


def test_parser_equals_brute_force(spark):
    rng = random.Random(1)
    bits = ["caption", "tags", "text", "subjects", '"', ":", "[", "]", "{", "}", ",", "\n", "\\", " ", "word", "<b>", "- ", "'", "```", "5"]
    rows = list(enumerate(REPLIES + ["".join(rng.choices(bits, k=rng.randrange(1, 25))) for _ in range(400)]))
    found = spark.createDataFrame(rows, "i int, reply string").select("i", R.parsed("reply").alias("r")).collect()
    want = {i: plainly(t) for i, t in rows}
    got = {r.i: (r.r.caption, r.r.subjects, r.r.text, r.r.tags) for r in found}
    # booleans in lists are spelt as in JSON
    want[10] = (want[10][0], want[10][1], want[10][2], ["x", "5", "true"])
    assert {i: (dict(rows)[i], got[i]) for i in got if got[i] != want[i]} == {}


def test_alike(spark):
    rows = [("A  cat", "x", "a cat on a mat", "X ", True), ("a", "", "b", "", False), ("", "", "", "", False), ("a", "t", "a", None, False), (None, None, "a", None, False)]
    df = spark.createDataFrame(rows, "a string, at string, b string, bt string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", R.alike("a", "at", "b", "bt")).collect())


def grounded(tier, labels, related, w=D.Wording()):
    by, seen = {}, set()
    for name, category in labels:
        name = name.strip()
        if not name or name.lower() in seen:
            continue
        seen.add(name.lower())
        by.setdefault(category, []).append(name)
    out, total = [], 0
    for facet in [*D.FACETS, *[c for c in by if c not in D.FACETS]]:
        own = by.get(facet, [])[:2][: 8 - total]
        total += len(own)
        if own:
            out.append(f"{facet}: {', '.join(own)}")
    if tier == "unknown" or not out:
        return w.nothing
    near = list(dict.fromkeys(r.strip().lower() for r in related if r.strip()))[:6]
    a, b = w.unsure if tier == "weak" else w.sure
    return a + "; ".join(out) + (f"{w.related[0]}{', '.join(near)}{w.related[1]}" if near else "") + b


def test_grounding_equals_brute_force(spark):
    rng = random.Random(2)
    items, labels, related, want = [], [], [], {}
    for i in range(60):
        tier = rng.choice(["recognized", "weak", "unknown"])
        own = [(rng.choice(["Drake", "drake ", "Pepe", "smug", "wave", "", "  ", "odd", "x1", "x2", "x3", "x4"]), rng.choice([*D.FACETS, "other", "more"])) for _ in range(rng.randrange(0, 30))]
        near = [rng.choice(["Rap", "rap", "", "b", "c", "d", "e", "f", "g", "h"]) for _ in range(rng.randrange(0, 14))]
        items.append((i, tier))
        labels += [(i, *x, p) for p, x in enumerate(own)]
        related += [(i, t, p) for p, t in enumerate(near)]
        want[i] = grounded(tier, own, near)
    got = D.grounding(spark.createDataFrame(items, "id int, tier string"), spark.createDataFrame(labels, "id int, label string, category string, position int"), spark.createDataFrame(related, "id int, term string, position int"))
    assert {r.id: r.grounding for r in got.collect()} == want



def first_union(values, cap=16):
    out, seen = [], set()
    for v in values:
        v = (v or "").strip()
        if v and v.lower() not in seen:
            seen.add(v.lower())
            out.append(v)
    return out[:cap]


def texts_of(values):
    kept = []
    for raw in values:
        t = re.sub(r"\s+", " ", raw or "").strip()
        if not t or any(t.lower() in k.lower() for k in kept):
            continue
        kept = [k for k in kept if k.lower() not in t.lower()] + [t]
    return "\n".join(kept)


def test_frames_of_an_item_merge(spark):
    rng = random.Random(3)
    rows, want = [], {}
    words = ["a", "A", "b", "cc", "Cc d", "e f", None, " ", "a b"]
    for i in range(50):
        n = rng.randrange(1, 9)
        own = [(rng.choice(words), rng.choices(words, k=rng.randrange(12)), " ".join(rng.choices(["up", "Up", "and", "down", " "], k=rng.randrange(5))), [f"t{rng.randrange(40)}" for _ in range(rng.randrange(9))]) for _ in range(n)]
        rows += [(i, o, *x) for o, x in enumerate(own)]
        if n == 1:
            want[i] = own[0]
        else:
            want[i] = (" / ".join(first_union([x[0] for x in own])[:2])[:240], first_union([v for x in own for v in x[1]]), texts_of([x[2] for x in own]), first_union([v for x in own for v in x[3]]))
    rng.shuffle(rows)
    got = D.merged(spark.createDataFrame(rows, "id int, ordinal int, caption string, subjects array<string>, text string, tags array<string>")).collect()
    assert {r.id: tuple(r)[1:] for r in got} == {i: tuple(w) for i, w in want.items()}
