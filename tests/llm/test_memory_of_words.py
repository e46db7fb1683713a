"""What a worker keeps of the words it has met."""

import numpy as np
import pyarrow as pa

from gleanery.llm import packing, tokens


def test_a_full_cache_keeps_the_words_at_hand():
    known, plain = tokens.WordTokenizer(tokens.tokenizer_path(), max_words=6), tokens.WordTokenizer(tokens.tokenizer_path())
    known.encode(["one two three four"])
    learnt, learn = [], known.learn
    known.learn = lambda new: (learnt.append(set(new)), learn(new))
    text = "one two five six seven"
    assert np.array_equal(known.encode([text])[0], plain.encode([text])[0])
    assert learnt == [{"five", "six", "seven"}] and len(known.ids) <= 6


def learnt_by(known):
    learnt, learn = [], known.learn
    known.learn = lambda new: (learnt.extend(new), learn(new))
    return learnt


def test_frequent_words_outlast_a_full_cache():
    known = tokens.WordTokenizer(tokens.tokenizer_path(), max_words=60)
    learnt = learnt_by(known)
    for i in range(200):
        known.encode([f"a {('red', 'blue')[i % 2]} word{i} other{i}"])
        assert len(known.ids) + len(known.older) <= 60
    assert learnt.count("red") == learnt.count("blue") == 1


def test_a_mark_makes_no_new_word():
    known = tokens.WordTokenizer(tokens.tokenizer_path())
    learnt = learnt_by(known)
    known.encode(["so red, blue, red. blue; red\nso blue: and red"])
    assert sorted(learnt) == sorted({"\n\nso", "red", "blue", "\n\n,", "\n\n.", "\n\n;", "\nso", "\n\n:", "and"})


def test_a_sparing_task_gives_the_same_pieces_and_keeps_no_words(spark):
    docs = spark.createDataFrame([(i, f"some words {i} and more " * 50) for i in range(20)], "doc_id long, text string")
    made = [sorted(map(str, packing.pieces(docs, sparing=s).collect())) for s in (False, True)]
    assert made[0] == made[1]

    def kept(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens.tokenizer(tokens.tokenizer_path(), packing.SPARING_WORDS).ids)], pa.int64())], ["doc_id"])

    assert {r.doc_id for r in docs.coalesce(1).mapInArrow(kept, "doc_id long").collect()} == {0}
