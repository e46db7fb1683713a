import hashlib
import random
import re

from gleanery.llm import secrets

ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""


def brute(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def listed(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans(spark, odd_docs, no_docs):
    rng = random.Random(2)
    bits = ["token", "=", ":", " ", "'", '"', "password", "API_KEY", "apikey", "abc", "defghij", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789ab", "deadbeef", "é", "\n", "ſecret", "kelvin", "x"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    for i, text in rows:
        spans, r = brute(text), found[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert set(listed(spans).split(",")) - {""} <= set(r.spans.split(","))
    assert secrets.find_secrets(odd_docs).count() == odd_docs.count()
    assert secrets.find_secrets(no_docs).count() == 0 and secrets.redact(no_docs).count() == 0


WEAK = "Zx9" + "aB3dE6gH" * 3
ACCESS = "AKIA" + "A1B2" * 4


def kinds(spark, text):
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    return [s.kind for s in row.found]


def test_weak_parts_need_their_complement(spark):
    assert kinds(spark, f"see {WEAK} here") == []
    assert kinds(spark, f"id {ACCESS} and {WEAK}") == ["access", "secret"]
    assert kinds(spark, f"id {ACCESS} and {WEAK} at https://x.example/a") == ["access", "secret", "endpoint"]
    assert kinds(spark, f"id {ACCESS} " + "word " * 80 + WEAK) == ["access"]
    assert kinds(spark, f"id {ACCESS}\n\n{WEAK}") == ["access"]
    assert kinds(spark, f"client_id = user77 secret={WEAK}") == ["ident", "assign"]
    assert kinds(spark, "https://x.example/a client_id = user77") == []


def test_secret_after_equals_and_long(spark):
    aws = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    text = f"AWS_ACCESS_KEY_ID={ACCESS}\nAWS_SECRET_ACCESS_KEY={aws}"
    assert kinds(spark, text) == ["access", "secret"]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.redact(docs).first().text == "AWS_ACCESS_KEY_ID=[SECRET]\nAWS_SECRET_ACCESS_KEY=[SECRET]"
    for key in ("private_key", "pwd", "access_key"):
        assert kinds(spark, f"client_id=user77 {key}={WEAK}") == ["ident", "secret"]
    assert kinds(spark, f"https://x.example/a?client_id=user77&sig={WEAK}") == ["endpoint", "ident", "secret"]
    assert kinds(spark, f"x={WEAK}") == []
    long = ("Zx9aB3dE6g" * 15)[:150]
    docs = spark.createDataFrame([(1, f"id {ACCESS} and {long} end")], "doc_id long, text string")
    assert [(s.kind, s.end - s.start) for s in secrets.find_secrets(docs).first().found] == [("access", 20), ("secret", 150)]
    assert secrets.redact(docs).first().text == "id [SECRET] and [SECRET] end"
    assert secrets.scan("aB3" * 300_000) == [(4, 0, 900_000)] and secrets.scan("xy3" * 300_000) == []


def test_gap_counts_from_the_end_of_a_part(spark):
    jwt = "eyJ" + "hbGciOiJI" * 44
    assert kinds(spark, f"token={jwt} client_id=app77") == ["assign", "ident"]
    assert kinds(spark, f"client_id=app77 token={jwt} {WEAK} tenant_id=abcd") == ["ident", "assign", "secret", "ident"]
    assert kinds(spark, f"https://x.example/{'a/' * 200} {ACCESS} {WEAK}") == ["endpoint", "access", "secret"]


def test_links_by_brute_force(spark):
    rng = random.Random(6)
    bits = ["client_id=app77", "token=" + "q" * 300, "token=abcdefgh", ACCESS, WEAK, "Zx9" * 100, "https://x.example/" + "a/" * 150, "https://x.example/a", "word " * 20, "w " * 60, "\n\n"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(200)]
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.found] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        blanks = [m.start() for m in secrets.BLANK.finditer(text)]
        every = [(a, k, b, sum(x <= a for x in blanks)) for k, a, b in secrets.scan(text)]
        near = lambda p, ks: any(q[1] in ks and q[3] == p[3] and max(q[0], p[0]) - min(p[2], q[2]) <= secrets.WINDOW for q in every)
        kept = [p for p in every if p[1] < 3 or ((p[1] == 4 or near(p, (0, 2, 4))) and (p[1] == 3 or near(p, (1, 3))))]
        assert sorted(found[i]) == sorted((a, secrets.KINDS[k], b) for a, k, b, _ in kept), text


def test_redact(spark, odd_docs):
    rows = [(1, "a token=abcdefgh b", 18, "s"), (1, "a token=abcdefgh b", 18, "s"), (1, "other text", 10, "s"), (None, "x password: 'hunter22'", 22, "s"), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, start string")
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    assert sorted(out.collect(), key=str) == sorted([(1, "a [SECRET] b", 12, "s"), (1, "a [SECRET] b", 12, "s"), (1, "other text", 10, "s"), (None, "x [SECRET]'", 11, "s"), (2, None, None, None)], key=str)
    assert secrets.redact(odd_docs).exceptAll(odd_docs).count() == 0
    clashing = docs.selectExpr("*", "7 as _hash", "7 as _h", "7 as _ID", "array(7) as _spans", "7 as _cut", "7 as kind")
    assert secrets.redact(clashing).columns == clashing.columns
    assert sorted(tuple(r)[:4] for r in secrets.redact(clashing).filter("doc_id = 1").collect()) == [(1, "a [SECRET] b", 12, "s")] * 2 + [(1, "other text", 10, "s")]
    assert {(r._hash, r._h, r._ID, tuple(r._spans), r._cut, r.kind) for r in secrets.redact(clashing).collect()} == {(7, 7, 7, (7,), 7, 7)}


def test_redact_of_many_spans_and_without_broadcast(spark, monkeypatch):
    text = "".join(f"w{i} token=abcdefgh{i} " for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "clean")], "doc_id long, text string")
    wanted = {1: "".join(f"w{i} [SECRET] " for i in range(20_000)), 2: None, 3: "clean"}
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == wanted
    monkeypatch.setattr(secrets, "MASKED", 0)
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == wanted
