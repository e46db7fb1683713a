import random
import zlib

import numpy as np
import pytest

from gleanery.llm import common, language_id, quality

SOUNDS = {"aa": ("tion", "ing", "er", "th", "an"), "bb": ("schl", "keit", "ung", "ein", "pf"), "cc": ("eau", "oi", "ment", "re", "qu"), "dd": ("ado", "cion", "ez", "os", "ll")}


def say(rng, lang, n=40):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.mark.parametrize("n", [2, 3, 4, 7, 12, 40])
def test_codewords(n):
    code = language_id.codewords(n)
    apart = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
    assert apart >= (2 ** (n - 2) if n <= 7 else 8)
    assert all(0 < (code[:, b] > 0).sum() < n for b in range(code.shape[1]))


def test_language(spark, odd_docs, no_docs):
    rng = random.Random(1)
    rows = [(i, say(rng, lang), lang, i) for i in range(400) for lang in [rng.choice("abcd") * 2]] + [(900, None, "aa", 1), (901, "12 !", "aa", 1), (902, say(rng, "aa"), None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    model = language_id.learn(docs)
    assert model.languages == ["aa", "bb", "cc", "dd"]
    found = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [r for r in rows[:400] if found[r[0]].held_out]
    assert 90 < len(held) < 180 and sum(found[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.98
    assert found[900].lang_pred == found[901].lang_pred == "und" and found[900].score == 0 and found[902].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language_id.keep_known(docs, model).count() >= 398
    assert language_id.predict(odd_docs, model).count() == odd_docs.count() and language_id.predict(no_docs, model).count() == 0
    nothing = language_id.learn(no_docs)
    assert {r.lang_pred for r in language_id.predict(odd_docs, nothing).collect()} == {"und"}
    one = language_id.learn(docs.filter("lang = 'aa'"))
    assert {r.lang_pred for r in language_id.predict(docs, one).collect()} == {"aa", "und"}


def test_a_mixed_text_is_flagged(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, say(rng, "ab"[i % 2] * 2, 60), "ab"[i % 2] * 2) for i in range(200)], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert not any(r.ambiguous for r in language_id.predict(docs, model).collect())
    _, _, unsure = model.predict([" ".join(say(rng, lang, 1) for _ in range(4000) for lang in ("aa", "bb"))])
    plain = model.predict([say(rng, "aa", 50)])
    assert not plain[2][0] and unsure.shape == (1,)


def test_trigrams_of_a_batch_are_those_of_its_texts():
    texts = ["Ab  c1d", "", "é!", "xyz"]
    gram, at, some = language_id.trigrams(texts)
    assert some.tolist() == [True, False, True, True]
    for t, a, b in zip(texts, at[:-1], at[1:]):
        own, _, _ = language_id.trigrams([t])
        assert gram[a:b].tolist() == own.tolist()


def bad(rng):
    return "".join(rng.choice("#$%&*") + rng.choice(["xq", "zz", "kk"]) for _ in range(60))


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    p = sum(labels)
    return (order[np.array(labels) == 1].sum() - p * (p - 1) / 2) / (p * (len(labels) - p))


def test_quality(spark, odd_docs, no_docs):
    rng = random.Random(3)
    labels = [(i, int(rng.random() < 0.7)) for i in range(600)]
    rows = [(i, say(rng, "aa") if y else bad(rng) + say(rng, "aa", 20)) for i, y in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as label", "1.0D as score")
    marks = spark.createDataFrame([(i, y, 0) for i, y in labels] + [(None, 1, 0), (5000, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    machine = quality.learn(docs, marks)
    found = {r.doc_id: r for r in quality.score(docs, machine).collect()}
    held = [(found[i].score, y) for i, y in labels if found[i].held_out]
    assert 60 < len(held) < 200 and auc([s for s, _ in held], [y for _, y in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in found.values())
    assert quality.score(odd_docs, machine).filter("score is not null and score between 0 and 1").count() == odd_docs.count()
    assert quality.score(no_docs, machine).count() == 0
    plain = quality.learn(docs, marks.filter("quality = 1"))
    assert {round(r.score, 3) for r in quality.score(docs, plain).collect()} == {1.0}
    assert {r.score for r in quality.score(docs, quality.learn(docs, marks.limit(0))).collect()} == {0.5}


def test_machine_equals_all_pairs():
    """The linear-time score is that of the sum over all pairs of features."""
    rng = np.random.default_rng(0)
    size, width = 1 << quality.WORD_BITS, len(quality.STATISTICS)
    m = quality.Machine(0.1, np.zeros(width), np.ones(width), rng.normal(0, 0.1, size), rng.normal(0, 0.1, (size, quality.RANK)), rng.normal(0, 0.1, width), rng.normal(0, 0.1, (width, quality.RANK)))
    text = "some words and some more words"
    words, _, stats = quality.features([text])
    x = [*np.clip(stats[0], -5, 5), *[1 / len(words)] * len(words)]
    v, w = np.concatenate([m.stat_v, m.word_v[words]]), np.concatenate([m.stat_w, m.word_w[words]])
    total = m.bias + np.dot(w, x) + sum(v[i] @ v[j] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert abs(m.score([text])[0] - 1 / (1 + np.exp(-total))) < 1e-9


def test_learning_is_bounded(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, say(rng, "aa")) for i in range(100)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    # Rows of one doc_id and repeated labels stay within the bound too.
    assert quality.training_rows(docs.union(docs), marks.union(marks), 10).count() == 10
    assert quality.training_rows(docs, marks, 1000).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(100))
    quality.learn(docs, marks, train_rows=10)


def test_many_languages(spark):
    rng = random.Random(5)
    sounds = {f"l{k:03d}": [rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(5)] for k in range(450)}
    rows = [(3 * i + j, " ".join("".join(rng.choice(own) for _ in range(3)) for _ in range(30)), lang) for i, (lang, own) in enumerate(sounds.items()) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    taught = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert model.languages == sorted({r[2] for r in taught})
    names = model.predict([r[1] for r in taught])[0]
    assert sum(n == r[2] for n, r in zip(names, taught)) > 0.85 * len(taught)


def test_codeword_training_and_decoding_equal_recomputation(spark, rng):
    """Shares, bits' log-odds, their trust, losses and the choice, one language, bit and text at a time."""
    languages = sorted(SOUNDS)
    rows = [(i, say(rng, languages[i % len(languages)], rng.randrange(1, 30)), languages[i % len(languages)]) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    taught = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    counts = {x: np.zeros(language_id.DIMENSIONS) for x in languages}
    for _, text, lang in taught:
        np.add.at(counts[lang], language_id.trigrams([text])[0], 1)
    shares = {x: (n + language_id.SMOOTH) / (n.sum() + language_id.SMOOTH * language_id.DIMENSIONS) for x, n in counts.items()}
    assert model.languages == languages
    odds, trust = [], []
    for b in range(model.code.shape[1]):
        one = np.mean([shares[x] for x, c in zip(languages, model.code) if c[b] > 0], axis=0)
        zero = np.mean([shares[x] for x, c in zip(languages, model.code) if c[b] < 0], axis=0)
        odds.append(np.log(one / zero))
        trust.append(((one - zero) * odds[-1]).sum())
    trust = np.array(trust) / np.mean(trust)
    for r in language_id.predict(docs, model).collect():
        gram = language_id.trigrams([rows[r.doc_id][1]])[0]
        outcome = [o[gram].mean() for o in odds]
        loss = [sum(t * np.logaddexp(0, -language_id.SHARPNESS * x * c) for t, x, c in zip(trust, outcome, code)) for code in model.code]
        share = np.exp(min(loss) - np.array(loss))
        assert r.lang_pred == languages[int(np.argmin(loss))] or sorted(loss)[1] - min(loss) < 1e-3
        assert abs(r.score - share.max() / share.sum()) < 1e-3
        assert r.ambiguous == (sorted(loss)[1] - min(loss) < language_id.AMBIGUOUS) or abs(sorted(loss)[1] - min(loss) - language_id.AMBIGUOUS) < 1e-3
