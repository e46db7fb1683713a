import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import common, packing, token_rollup, tokens


def plain_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


def test_cached_ids_equal_plain_ids(monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", 50)
    known = tokens.WordTokenizer(tokens.tokenizer_path(), max_words=40)
    rng = random.Random(3)
    bits = ["a", "the", "é", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "12", " x", " \n", "<|endoftext|>", "　", "\r\n", "_", "“", "日本"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    for text, ids in zip(texts, known.encode(texts)):
        assert ids.tolist() == plain_ids(text)


def test_ids_beside_whitespace_of_other_kinds_and_marks(monkeypatch):
    # a no-break space between blanks is one token with them
    known = tokens.WordTokenizer(tokens.tokenizer_path(), max_words=60)
    rng = random.Random(4)
    spaces = [" ", " \u00a0", "\u00a0", "\t", "\u2003", "\x1c", "\n", "\r"]
    bits = ["a", "Été", "12", "×", "'s", "²", "日", ",", ".", ";", '"', "?!", ":", "x,", "y.", ", ", ". ", ",\n", "<|endoftext|>", " ", " ", " b", " c"]
    texts = ["x \u00a0 \u00a0 y", "a, b", "a,, b", "a , b", '"a", b', "a,\nb", "a, \nb", "it's, or", "×, b", "²; b", ", b", "a\n, b", "a,", "a, "]
    texts += ["".join(rng.choice(bits if rng.random() < 0.9 else spaces) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    wanted = [e.ids for e in known.inner.encode_batch(texts, add_special_tokens=False)]
    assert wanted[0] == plain_ids(texts[0])
    for stretch in (tokens.STRETCH, 20):
        monkeypatch.setattr(tokens, "STRETCH", stretch)
        for text, ids, found in zip(texts, wanted, known.encode(texts)):
            assert found.tolist() == ids, text
        for text, ids in zip(texts[:14], wanted):
            assert known.encode([text])[0].tolist() == ids, text


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
def test_lengths(n):
    found = packing.piece_lengths(n)
    assert sum(found) == n and all(x & (x - 1) == 0 and x <= 1024 for x in found)
    assert len([x for x in found if x < 1024]) == bin(n % 1024).count("1")


def test_pack_round_trip(odd_docs):
    rows = packing.pack(odd_docs, max_len=64).collect()
    wanted = sorted(len(plain_ids(r.text or "")) + 1 for r in odd_docs.collect())
    by_doc = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes())
        by_doc[r.doc_id].append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert sum(r.length for r in rows) == sum(wanted)
    for r in odd_docs.filter("doc_id in (2, 3, 4, 5)").collect():
        ids = [i for p in sorted(by_doc[r.doc_id], key=lambda p: p.start) for i in p.ids]
        assert ids == [*plain_ids(r.text or ""), 0]


def test_pack_nothing(no_docs):
    assert packing.pack(no_docs).count() == 0


def brute_totals(docs):
    out = defaultdict(lambda: [0, 0, 0])
    for r in docs:
        for name, n in ((token_rollup.BPE, len(plain_ids(r.text or ""))), (token_rollup.WORDS, len((r.text or "").split()))):
            t = out[r.source, r.lang, name]
            t[0] += 1
            t[1] += n
            t[2] += len(r.text or "")
    return {k: tuple(v) for k, v in out.items()}


def found_totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens, r.chars) for r in rollup.totals().collect()}


def test_rollup(spark, odd_docs, no_docs):
    rollup = token_rollup.Rollup(spark, common.scratch_dir(spark, "rollup"))
    assert found_totals(rollup) == {}
    assert rollup.commit(1, inserts=odd_docs)
    assert found_totals(rollup) == brute_totals(odd_docs.collect())
    assert not rollup.commit(1, inserts=odd_docs)  # a repeated commit
    new = spark.createDataFrame([(1, "three new words", "fr", "c"), (9, "more", "fr", "c")], "doc_id long, text string, lang string, source string")
    assert rollup.commit(2, inserts=new, deletes=new.unionByName(odd_docs.filter("doc_id = 4").select(new.columns)))
    kept = [r for r in odd_docs.collect() if r.doc_id not in (1, 4)] + new.collect()
    assert found_totals(rollup) == brute_totals(kept)
    assert rollup.commit(3, inserts=no_docs, deletes=no_docs)
    assert found_totals(rollup) == brute_totals(kept)
    with pytest.raises(ValueError):
        rollup.commit(0, inserts=new)
    # one id's folder is a share of the history, and compaction leaves one table without what cancels out
    one, every = rollup.history(new.filter("doc_id = 9")), rollup._read("entries")
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert len(one.select("part").distinct().collect()) == 1 and one.filter("doc_id = 9").count() > 0
    assert files(one) < files(every) / 2
    rollup.compact()
    assert found_totals(rollup) == brute_totals(kept) and not rollup.commit(2, inserts=new)
    assert all("compact_entries" in f for f in rollup._read("entries").inputFiles())
    assert rollup._read("entries").filter("sign < 0").count() == 0
    assert rollup.commit(4, deletes=new)
    assert found_totals(rollup) == brute_totals([r for r in kept if r.doc_id not in (1, 9)])
    rollup.compact()
    assert found_totals(rollup) == brute_totals([r for r in kept if r.doc_id not in (1, 9)])


def test_op2_leaves_one_of_each_copy(spark, tmp_path, odd_docs):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.source, r.lang, r.tokenizer): r.docs for r in token_rollup.op2_token_rollup(spark, str(tmp_path)).collect()}
    assert sum(n for (_, _, t), n in found.items() if t == token_rollup.WORDS) == odd_docs.count()  # copies with one doc_id are one document
