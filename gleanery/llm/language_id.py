"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over hashed character trigrams tells the languages with a 1 from
those with a 0: its weight for a trigram is the log-odds of the two sides' trigram distributions, in which every language counts alike
however many documents it has. A text's outcome for a bit is the mean weight of its trigrams. Decoding adds up, for each language, the
logistic losses of its codeword's bits, weighted by how far apart the bit's two sides are; the nearest codeword wins. The score is the winner's share of the
softmax over negative losses, and a text whose two nearest codewords are within ``AMBIGUOUS`` of each other is flagged.

Trigram counts come from all labelled rows of the training fold: added up per task and language, then by a groupBy; a second one adds up the languages' shares for
each trigram and bit. DIMENSIONS rows of a number a bit come to the driver, and the names of the languages. Prediction is one pass without a shuffle.

A null text, or one without a letter, is ``und`` with score 0, as is every text when nothing can be learnt. Rows with a null lang or null doc_id teach
nothing. Repeated rows count each. Other columns are ignored, or kept by ``keep_known``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache as memo

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import common

DIMENSIONS = 1 << 15
SMOOTH = 0.5
#: Outcomes are multiplied by this before the loss.
SHARPNESS = 4.0
AMBIGUOUS = 0.05
#: Up to so many languages their codewords are broadcast; beyond, they meet the counts in a shuffled join.
BROADCAST_LANGUAGES = 10_000
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"


def _least_distance(code: np.ndarray) -> int:
    """The fewest bits in which two rows differ."""
    x, least = code.astype(np.float32), code.shape[1]
    for a in range(0, len(x), 512):
        same = x[a : a + 512] @ x.T
        same[np.arange(len(same)), np.arange(a, a + len(same))] = -code.shape[1]
        least = min(least, int((code.shape[1] - same.max()) / 2))
    return least


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language; all bits differ and split the languages.

    Up to 7 languages have the exhaustive code of 2^(languages - 1) - 1 bits, more have the best of some random codes of 12 bits per doubling.
    """
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= 7:
        bits = 2 ** (languages - 1) - 1
        rows = [[1 if (b >> k) & 1 else -1 for b in range(bits)] for k in range(languages - 1)]
        return np.array([[1] * bits, *rows], np.int8)
    bits = 12 * int(np.ceil(np.log2(languages)))
    best, least = None, -1
    for seed in range(30):
        code = np.where(np.random.default_rng(seed).random((languages, bits)) < 0.5, -1, 1).astype(np.int8)
        code = code[:, np.abs(code.sum(0)) < languages]
        apart = _least_distance(code)
        if apart > least:
            best, least = code, apart
    return best


@memo
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-cased letters, all else being one blank; where each text's begin (one more at the end); who has letters.

    A text counts with a blank on either side.
    """
    low = [t.lower() for t in texts]
    joined = np.frombuffer("\x00\x00".join(["", *low, ""]).encode("utf-32-le"), np.uint32)
    begin = np.cumsum([1, *(len(t) + 2 for t in low)])
    letter = letters()[joined]
    own = np.where(letter, joined, 0)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # of blanks in a row the first
    keep[begin - 1] = True
    at = np.cumsum(keep) - keep
    starts = at[begin - 1]
    own = own[keep].astype(np.uint64)[: starts[-1]]
    if len(own) < 3:
        h, counts = np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    else:
        h = own[:-2] * np.uint64(0x9E3779B1) ^ own[1:-1] * np.uint64(0x85EBCA77C2B2AE63) ^ own[2:] * np.uint64(0x27D4EB2F165667C5)
        inside = np.arange(2, len(own)) < np.repeat(starts[1:], np.diff(starts))[:-2]  # the last is of the same text
        h = (h[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
        counts = np.maximum(0, np.diff(starts) - 2)
    places = np.concatenate([[0], np.cumsum(counts)])
    some = np.diff(np.concatenate([[0], np.cumsum(letter)])[np.append(begin[:-1], begin[-1])]) > 0
    return h.astype(np.int64), places, some


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # trigrams * bits
    trust: np.ndarray  # of bits

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and flags of ambiguity."""
        gram, at, some = trigrams(texts)
        names, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not self.languages:
            return names, score, unsure
        outcome = np.zeros((len(texts), self.code.shape[1]))
        n = np.diff(at)
        full = np.flatnonzero(n > 0)
        if len(full) and self.code.shape[1]:
            outcome[full] = np.add.reduceat(self.weights[gram], at[:-1][full], axis=0, dtype=np.float64) / n[full, None]
        loss = (np.logaddexp(0, -SHARPNESS * outcome[:, None, :] * self.code[None]) * self.trust).sum(2)
        odds = np.exp(loss.min(1, keepdims=True) - loss)
        share = odds / odds.sum(1, keepdims=True)
        best = loss.argmin(1)
        if len(self.languages) > 1:
            two = np.partition(loss, 1, axis=1)
            unsure = (two[:, 1] - two[:, 0] < AMBIGUOUS) & some
        for i in np.flatnonzero(some):
            names[i], score[i] = self.languages[best[i]], share[i, best[i]]
        return names, score, unsure


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def learn(docs: DataFrame) -> Model:
    """From text and lang of rows outside the held-out fold."""
    rows = docs.select("text", "lang", "doc_id").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part, texts in common.slices(batches, "text"):
            gram, at, _ = trigrams(texts)
            langs = np.array(part.column(1).to_pylist(), dtype=object)
            of = np.repeat(langs, np.diff(at))
            for lang in sorted(set(langs)):
                own = np.bincount(gram[of == lang], minlength=DIMENSIONS)
                totals[lang] = totals.get(lang, 0) + own
        for lang, n in totals.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[some])], ["lang", "gram", "n"])

    counted = common.written(rows.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    totals = {r["lang"]: r["total"] for r in counted.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals)
    code = codewords(len(languages))
    bits = code.shape[1]
    if not bits:
        common.discard(counted)
        return Model(languages, code, np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0))
    full = np.array([totals[x] + SMOOTH * DIMENSIONS for x in languages])
    words = counted.sparkSession.createDataFrame([(x, float(t), c.tolist()) for x, t, c in zip(languages, full, code)], "lang string, total double, code array<int>")
    met = counted.join(F.broadcast(words) if len(languages) <= BROADCAST_LANGUAGES else words, "lang").withColumn("share", F.col("n") / F.col("total"))
    sums = met.groupBy("gram").agg(F.sum("share"), *[F.sum(F.when(F.get("code", F.lit(b)) > 0, F.col("share")).otherwise(0.0)) for b in range(bits)]).toPandas().to_numpy(np.float64)
    common.discard(counted)
    every, ones = np.full(DIMENSIONS, (SMOOTH / full).sum()), np.tile(((code > 0) * (SMOOTH / full)[:, None]).sum(0), (DIMENSIONS, 1))
    gram = sums[:, 0].astype(np.int64)
    every[gram] += sums[:, 1]
    ones[gram] += sums[:, 2:]
    n = (code > 0).sum(0)
    one, zero = ones / n, (every[:, None] - ones) / (len(languages) - n)
    odds = np.log(one / zero)
    trust = ((one - zero) * odds).sum(0)
    return Model(languages, code, odds.astype(np.float32), trust / trust.mean())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: a row for each document."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.slices(batches, "text"):
            names, score, unsure = known.value.predict(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(look, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is known and not ambiguous, unchanged."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.slices(batches, "text"):
            names, _, unsure = known.value.predict(texts)
            yield part.filter(pa.array([n != UNKNOWN and not u for n, u in zip(names, unsure)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op8_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
