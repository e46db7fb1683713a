"""Quality classification by a factorisation machine.

Features of a text: its hashed words, each occurrence with value 1 / words, and structure statistics (standardised). The
score is the logistic of ``w0 + sum(w x) + 1/2 sum_f ((sum v_f x)^2 - sum (v_f x)^2)``: all pairwise interactions of low rank, in time linear in the
number of words.

Metadata columns are left out: of those of the documents, lang, source and doc_id may not bear on a score, and n_chars is the text's own length.

The machine learns by Adam over mini-batches in one task, from at most TRAIN_ROWS labelled texts (the first in the order of a hash of
doc_id); their features, 4 bytes a word, not their texts, go there. Scoring is one pass without a shuffle.

A null text counts as empty and still has a score. Labels other than 0 and 1, null doc_ids and texts that no label names teach nothing; without both labels
among the training rows every score is the share of ones (1/2 if there are no rows). Repeated rows are scored each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import common, textvec

TRAIN_ROWS = 12_000
WORD_BITS, RANK = 12, 8
EPOCHS, BATCH, RATE, DECAY = 6, 256, 0.02, 1e-4
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
STATISTICS = ("log_chars", "log_words", "word_length", "distinct", "upper", "digit", "other", "symbol", "line_words", "repeated_lines")
#: Character classes of UTF-8 bytes: 1 upper, 2 digit, 3 bytes above ASCII, 4 common marks, 5 other symbols; 0 lower or blank.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[*range(97, 123), 32, *range(9, 14)]] = 0
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 4


def _spread(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of distinct keys in each stretch."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(at) - 1)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets of all texts, where each text's begin (one more at the end), and the statistics' rows."""
    hashes, at = textvec.word_hashes(texts)
    lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    kinds = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    share = np.bincount(owner * 6 + kinds, minlength=6 * len(texts)).reshape(-1, 6) / np.maximum(1, np.diff(ends))[:, None]
    words, n_lines = np.diff(at), np.array([len(x) for x in lines])
    stats = np.stack([
        np.log1p(np.diff(ends)), np.log1p(words), share.shape[0] and np.diff(ends) / np.maximum(1, words), _spread(hashes, at) / np.maximum(1, words),
        share[:, 1], share[:, 2], share[:, 3], share[:, 5], np.log1p(words / np.maximum(1, n_lines)), 1 - np.array([len(set(x)) for x in lines]) / np.maximum(1, n_lines),
    ], axis=1).astype(np.float64)
    stats[:, 2] = np.log1p(stats[:, 2])
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), at, stats


@dataclass
class Machine:
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    word_w: np.ndarray  # buckets
    word_v: np.ndarray  # buckets * RANK
    stat_w: np.ndarray
    stat_v: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        words, at, stats = features(texts)
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        n = np.maximum(1, np.diff(at))
        table = np.concatenate([self.word_w[:, None], self.word_v, (self.word_v**2).sum(1, keepdims=True)], axis=1)
        sums = np.zeros((len(texts), RANK + 2))
        full = np.flatnonzero(np.diff(at) > 0)
        if len(full):
            sums[full] = np.add.reduceat(table[words], at[:-1][full], axis=0)
        first, second = sums[:, : RANK + 1] / n[:, None], sums[:, RANK + 1] / n**2
        inner = first[:, 1:] + x @ self.stat_v
        out = self.bias + first[:, 0] + x @ self.stat_w + 0.5 * ((inner**2).sum(1) - second - (x**2) @ (self.stat_v**2).sum(1))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(words: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, seed: int = 7) -> Machine:
    """Adam on the logistic loss; rows come in a fixed order."""
    size, width = 1 << WORD_BITS, len(STATISTICS)
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    mean, scale = (stats.mean(0), np.maximum(stats.std(0), 1e-6)) if len(labels) else (np.zeros(width), np.ones(width))
    machine = Machine(float(np.log((share + 1e-6) / (1 - share + 1e-6))), mean, scale, np.zeros(size), np.zeros((size, RANK)), np.zeros(width), np.zeros((width, RANK)))
    if len(set(labels.tolist())) < 2:
        return machine
    # One table: statistics first, then words; column 0 is w, the others v.
    table = np.concatenate([np.zeros((width + size, 1)), rng.normal(0, 0.05, (width + size, RANK))], axis=1)
    m, s = np.zeros_like(table), np.zeros_like(table)
    bias = np.array([machine.bias, 0.0, 0.0])
    x_stats = np.clip((stats - mean) / scale, -5, 5)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            step += 1
            count = np.array([len(words[r]) for r in rows])
            index = np.concatenate([words[r] for r in rows]) + width if count.sum() else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(rows)), count)
            value = np.repeat(1 / np.maximum(1, count), count)
            x = x_stats[rows]
            own = table[index] * value[:, None]
            sums = np.stack([np.bincount(owner, own[:, c], len(rows)) for c in range(RANK + 1)], axis=1)
            squares = np.bincount(owner, (own[:, 1:] ** 2).sum(1), len(rows))
            inner = sums[:, 1:] + x @ table[:width, 1:]
            out = bias[0] + sums[:, 0] + x @ table[:width, 0] + 0.5 * ((inner**2).sum(1) - squares - (x**2) @ (table[:width, 1:] ** 2).sum(1))
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[rows]) / len(rows)
            grad = DECAY * table
            grad[:width, 0] += x.T @ error
            grad[:width, 1:] += x.T @ (error[:, None] * inner) - table[:width, 1:] * ((x**2).T @ error)[:, None]
            weight = error[owner] * value
            parts = [weight, *((weight[:, None] * (inner[owner] - own[:, 1:])).T)]
            grad[width:] += np.stack([np.bincount(index - width, p, size) for p in parts], axis=1)
            m = 0.9 * m + 0.1 * grad
            s = 0.999 * s + 0.001 * grad**2
            table -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            g = error.sum()
            bias[1:] = 0.9 * bias[1] + 0.1 * g, 0.999 * bias[2] + 0.001 * g * g
            bias[0] -= RATE * (bias[1] / (1 - 0.9**step)) / (np.sqrt(bias[2] / (1 - 0.999**step)) + 1e-8)
    machine.bias, machine.stat_w, machine.stat_v, machine.word_w, machine.word_v = float(bias[0]), table[:width, 0], table[:width, 1:], table[width:, 0], table[width:, 1:]
    return machine


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """label, words, stats of at most ``train_rows`` labelled rows outside the held-out fold; as many labels are broadcast to pick their texts."""
    fold = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = fold.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.slices(batches, "text"):
            words, at, stats = features(texts)
            listed = pa.ListArray.from_arrays(at.astype(np.int32), words.astype(np.int32))
            wide = pa.FixedSizeListArray.from_arrays(stats.ravel(), len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), listed, wide], ["doc_id", "label", "words", "stats"])

    # The limit holds the rows that share a labelled doc_id within the bound as well.
    found = rows.mapInArrow(look, "doc_id long, label int, words array<int>, stats array<double>")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "stats").limit(train_rows)


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """From training_rows(), in one task."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[np.ndarray] = []
        stats: list[np.ndarray] = []
        labels: list[int] = []
        for batch in batches:
            listed = batch.column(2)
            flat, at = listed.values.to_numpy(), listed.offsets.to_numpy()
            words += [flat[a:b].copy() for a, b in zip(at[:-1], at[1:])]
            stats += [np.array(x) for x in batch.column(3).to_pylist()]
            labels += batch.column(1).to_pylist()
        machine = fit(words, np.array(stats).reshape(-1, len(STATISTICS)), np.array(labels, np.float64))
        packed = [np.array([machine.bias]), machine.mean, machine.scale, machine.word_w, machine.word_v.ravel(), machine.stat_w, machine.stat_v.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(packed).tolist()], pa.list_(pa.float64()))], ["machine"])

    found = training_rows(docs, labels, train_rows).coalesce(1).mapInArrow(train, "machine array<double>").collect()
    if not found:
        return fit([], np.zeros((0, len(STATISTICS))), np.zeros(0))
    flat, width, size = np.array(found[0][0]), len(STATISTICS), 1 << WORD_BITS
    cut = np.split(flat, np.cumsum([1, width, width, size, size * RANK, width]))
    return Machine(float(cut[0][0]), cut[1], cut[2], cut[3], cut[4].reshape(size, RANK), cut[5], cut[6].reshape(width, RANK))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each document."""
    known = docs.sparkSession.sparkContext.broadcast(machine)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.slices(batches, "text"):
            found = known.value.score(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(look, "doc_id long, held_out boolean, score double, predicted int")


def op9_quality_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, learn(docs, common.table(spark, sf_dir, "labels")))
