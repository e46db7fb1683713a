"""Exact cases of scores, terms, tags and hashes."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import hashing, tags, text, vectors
from gleanery.operators import search


def none():
    return F.lit(None).cast("array<double>")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def arr(*xs, kind="double"):
    return F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")




def test_hybrid_score(spark):
    q, img = arr(0.0, 1.0), arr(0.6, 0.8)
    assert value(spark, vectors.hybrid_score(q, img, none())) == pytest.approx(0.8)
    assert value(spark, vectors.hybrid_score(q, img, arr())) == pytest.approx(0.8)
    assert value(spark, vectors.hybrid_score(q, img, arr(0.8660254, 0.5))) == pytest.approx(0.8)
    assert value(spark, vectors.hybrid_score(q, img, arr(0.0, 1.0))) == pytest.approx(0.8 + 0.9 * 0.45)


@pytest.mark.parametrize("hay,exact,expanded,query,want", [
    ("mad face", ["mad", "cat"], None, True, 1 + 0.35 * 0.5), ("mad cat", ["mad", "cat"], None, True, 1 + 0.35 + 0.6), ("angry rage", ["mad"], ["angry", "rage"], True, 1 + 0.22),
    ("mad cat", ["mad", "cat"], None, False, 0.95), ("nothing", ["mad", "cat"], None, False, 0.0), ("Gigachad", ["gigachad"], None, False, 0.0), ("education", ["cat"], None, False, 0.95),
])
def test_entry_score(spark, hay, exact, expanded, query, want):
    terms = arr(*exact, kind="string")
    more = None if expanded is None else arr(*expanded, kind="string")
    assert value(spark, search.entry_score(arr(1.0) if query else None, terms, arr(1.0), none(), F.lit(hay), more)) == pytest.approx(want)


def test_tag_score_outranks_a_perfect_cosine(spark):
    assert value(spark, search.tag_score(F.lit("smug pepe"), arr("pepe", kind="string"))) == 5.5
    assert value(spark, search.tag_score(F.lit("smug pepe"), arr("pepe", "dog", kind="string"))) == 1.25
    assert value(spark, search.tag_score(F.lit("smug"), arr("pepe", kind="string"))) == 0.0


def test_terms(spark):
    assert value(spark, text.search_terms(F.lit("me vs Angry"))) == ["angry"]
    assert value(spark, text.search_terms(F.lit("me vs angry"), True)) == ["me", "vs", "angry"]
    assert value(spark, text.union_terms(F.lit("a b  c"), F.lit("b d"))) == "a b c d"
    assert value(spark, text.terms_with_label(F.lit("x"), F.lit(" Smug Pepe "))) == "x smug pepe"
    assert value(spark, text.context_terms(F.lit("Stocks falling down again"), arr("Cat", "dog!", kind="string"))) == "cat dog dog cat stocks falling falling down down again"


@pytest.mark.parametrize("raw,want", [("McDonald's", "mcdonalds"), ("e t", ""), ("12345", ""), ("web3", ""), ("rrs", ""), ("mario 64", "mario 64"), ("space_odyssey", "space odyssey"), ("abc", ""), ("a b c d e f g", ""), ("[object Object]", ""), ("crying", "crying"), (None, "")])
def test_mined_terms(spark, raw, want):
    assert value(spark, text.mined_term(F.lit(raw).cast("string"))) == want


def test_display(spark):
    assert value(spark, text.title_case(F.lit("this is fine"))) == "This is Fine"
    assert value(spark, text.stem_key(F.lit("goblins"))) == "goblin"
    assert value(spark, text.term_category(F.lit("starter pack"))) == "format"
    assert value(spark, text.term_category(F.lit("anything else"))) == "topic"
    assert value(spark, text.minutes_text(F.lit(61_239_999))) == "1:01.23"
    assert value(spark, text.clean_transcript(F.lit("[music] hello (laughs)  ♪ there"))) == "hello there"


def test_html(spark):
    page = """<meta content="a &amp; b" property="og:title"><meta name="keywords" content="cat, dog"><script type="application/ld+json">{"keywords": ["x", {"name": "yy"}]}</script>
    "tags": ["p", {"title": "q"}] <a href="/tag/big%20one">"""
    assert value(spark, text.meta_content(F.lit(page), "og:video", "og:title")) == "a & b"
    assert value(spark, text.html_terms(F.lit(page))) == ["cat", "dog", "x", "yy", "p", "q", "big one"]
    assert value(spark, text.first_url(F.lit("look https://a.b/c). ok"))) == "https://a.b/c"
    assert value(spark, text.media_kind(F.lit("x.MP4"))) == "video" and value(spark, text.media_kind(F.lit("x.txt"))) is None


def fnv(s):
    h = 2166136261
    for c in s:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


@pytest.mark.parametrize("s", ["", "a", "hello world", "déjà"])
def test_hashes(spark, s):
    assert value(spark, hashing.fnv1a(F.lit(s))) == fnv(s)
    assert value(spark, hashing.chunk_of(F.lit(s))) == f"{fnv(s) % 64:02x}"
    h = 0
    for c in s:
        h = (h * 31 + ord(c) + (1 << 31)) % (1 << 32) - (1 << 31)
    assert value(spark, hashing.text_hash31(F.lit(s))) == h
    assert int(value(spark, hashing.fnv_text(F.lit(s))), 36) == fnv(s)


def tag_list(spark, *rows):
    return F.array(*[F.struct(F.lit(a).alias("label"), F.lit("t").alias("category"), F.lit(s).alias("score"), F.lit(src).cast("string").alias("source")) for a, s, src in rows]).cast(tags.TAGS)


def test_tags(spark):
    many = tag_list(spark, (" Cat", 0.2, "prompt"), ("cat", 0.1, "manual"), ("dog", 0.9, None), ("fox", 0.8, "vision"), ("", 1.0, "manual"), ("dog", 0.9, "prompt"))
    merged = value(spark, tags.merge_durable(many, 1))
    assert [(t.label, t.source) for t in merged] == [("cat", "manual"), ("fox", "vision")]
    assert [t.label for t in value(spark, tags.normalize(many))] == ["cat", "dog", "fox"]
    assert [t.label for t in value(spark, tags.with_tag(many, F.lit("New"), "user", "manual"))][:2] == ["new", "cat"]
    assert value(spark, tags.recognition_tier(tag_list(spark, ("a", 0.9, "vision")))) == "unknown"
    assert value(spark, tags.recognition_tier(tag_list(spark, ("a", 0.3, "prompt")))) == "weak"
    assert value(spark, tags.recognition_tier(tag_list(spark, ("a", 0.0, "ocr")))) == "recognized"
    assert [t.label for t in value(spark, tags.ocr_tags(F.lit("WAGMI pepe")))] == ["Pepe the Frog", "Crypto / NFT"]
    assert value(spark, tags.parse(F.lit("not json"))) == []
    for margin, p in ((0.1, 0.03), (0.19, 0.56), (0.225, 0.86), (0.3, 0.9)):
        assert value(spark, tags.confidence(F.lit(margin))) == pytest.approx(p)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "k long, v array<float>")
    assert {r.k: r["mean"] for r in vectors.mean_vector(df, "v", ("k",)).collect()} == {1: [2.0, 2.0], 2: [0.0, 2.0]}
    assert value(spark, vectors.unit(arr(0.0, 0.0))) == [0.0, 0.0]
    assert value(spark, vectors.max_cosine(arr(1.0), F.array().cast("array<array<double>>"))) == -1.0
    blobs = df.select("k", vectors.encode_floats("v").alias("b")).select("k", vectors.decode_floats("b").alias("v"))
    assert sorted(blobs.collect()) == sorted(df.collect())
    assert [r.scores for r in vectors.vector_scores(df.filter("k = 2"), "v", [[1.0, 1.0], [0.0, 3.0]]).collect()] == [[2.0, 6.0]]


def test_hashes_take_utf16_units(spark):
    def units(text):
        raw = text.encode("utf-16-be")
        return [raw[i] * 256 + raw[i + 1] for i in range(0, len(raw), 2)]

    texts = ["", "abc", "é ü", "a😀b", "日本"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.fnv1a("t").alias("f"), hashing.text_hash31("t").alias("h"), hashing.fingerprint("t").alias("p")).collect()
    for r in rows:
        f, h = 2166136261, 0
        for u in units(r.t):
            f = ((f ^ u) * 16777619) & 0xFFFFFFFF
            h = (h * 31 + u + 2**31) % 2**32 - 2**31
        assert (r.f, r.h) == (f, h) and int(r.p.split(".")[0], 36) == len(units(r.t)) and int(r.p.split(".")[1], 36) == f
    long = "abc" * 400_000
    f = 2166136261
    for u in units(long)[::2]:
        f = ((f ^ u) * 16777619) & 0xFFFFFFFF
    assert [int(x, 36) for x in value(spark, hashing.fingerprint(F.lit(long))).split(".")] == [1_200_000, f]
