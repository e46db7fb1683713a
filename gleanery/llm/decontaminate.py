"""Benchmark decontamination by the q-gram lemma.

Texts are compared in a normal form: bytes of the lower-cased text, runs of ASCII characters other than letters and digits as one space. A
document leaks an item when a region of WINDOW bytes of the item (the whole item if it is shorter) is in the document within the edit budget, one edit per PER_EDIT
bytes. Such a region shares at least ``w + 1 - q - q * k`` q-grams with the item, all of them near one diagonal. So q-grams that both
have are counted in overlapping diagonal bands, bands with too few in any window go, and the rest is verified by banded alignment.

Windows that share a stretch are verified together: if the stretch alone is beyond the budget, so are they. Counts that would take many rows are taken in parts, by items and by overlapping stretches of the texts.

Items of fewer than ``SHORT`` bytes leave no room for an edit: they are leaked where they stand whole between word bounds.

The items' q-grams are broadcast in blocks of at most BLOCK_BYTES of item text (16 bytes a q-gram in a worker); a benchmark of n bytes takes n // BLOCK_BYTES + 1 passes over the documents.
Documents are read once a pass and nothing is shuffled.

Null and empty texts leak nothing; null, empty items and items of fewer than ``LEAST`` bytes are too short to tell and are never leaked. Repeated rows are judged each. Empty
tables are allowed on either side. Other columns are ignored, or kept by ``drop_leaked``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import common, textvec

Q, WINDOW, PER_EDIT, LEAST, SHORT = 12, 80, 20, 12, 24
BLOCK_BYTES = 8_000_000
FILTER_BITS = 22
#: Rows of q-gram matches counted together, and rows aligned together.
MATCHES, ALIGNED = 1_000_000, 50_000
#: The longest stretch of window starts that share one stretch of the item.
STARTS = 40

_FORM = np.full(256, 32, np.uint8)
_FORM[128:] = np.arange(128, 256)
_FORM[48:58] = np.arange(48, 58)
_FORM[97:123] = _FORM[65:91] = np.arange(97, 123)


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' normal forms in one array, each after a 0, and where each begins (one more at the end)."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\x00".join([b"", *raw, b""]), np.uint8)
    mark = np.zeros(len(data), bool)
    mark[np.cumsum([0, *(len(r) + 1 for r in raw)])] = True
    form = _FORM[data]
    form[mark] = 0
    blank = form == 32
    keep = ~blank
    keep[1:] |= blank[1:] & (form[:-1] > 32)  # the first of a run, not at a text's start
    form = form[keep]
    return form, np.flatnonzero(form == 0) + 1


def grams(form: np.ndarray) -> np.ndarray:
    """Hashes of the q-grams that start at each place, Q - 1 fewer than bytes."""
    a = form.astype(np.uint64)
    for width in (1, 2, 4):
        a = a[:-width] | (a[width:] << np.uint64(8 * width))
    n = len(form) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return textvec.mix(a[:n] + np.uint64(textvec.BASE) * (a[Q - 8 : Q - 8 + n] >> np.uint64(8 * (16 - Q))))


@dataclass
class Index:
    """A block of items: their bytes one after the other, and their q-grams sorted by hash and item.

    ``keys`` holds the q-gram's rank among ``codes`` (distinct, sorted) and its item; ``place`` is where it begins in the item.
    """

    ids: list
    forms: list[np.ndarray]
    flat: np.ndarray
    begin: np.ndarray
    codes: np.ndarray
    keys: np.ndarray
    place: np.ndarray
    seen: np.ndarray


def make_index(items: list[tuple[int, str]]) -> Index:
    ids, forms = [], []
    for item_id, text in items:
        form, at = normal([text or ""])
        form = form[1:-1]
        form = form[:-1] if len(form) and form[-1] == 32 else form
        if len(form) >= LEAST:
            ids.append(item_id)
            forms.append(form)
    own = [grams(f) for f in forms]
    counts = [len(g) for g in own]
    every = np.concatenate([np.zeros(0, np.uint64), *own])
    codes, rank = np.unique(every, return_inverse=True)
    keys = (rank.astype(np.int64) << 32) | np.repeat(np.arange(len(forms)), counts)
    place = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in counts)])
    order = np.argsort(keys, kind="stable")
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(codes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    begin = np.cumsum([0, *(len(f) for f in forms)])
    return Index(ids, forms, np.concatenate([np.zeros(0, np.uint8), *forms]), begin, codes, keys[order], place[order], seen)


def budget(length: int) -> tuple[int, int, int]:
    """Region length, edits allowed, and the least number of shared q-grams for an item of ``length`` bytes."""
    w = min(length, WINDOW)
    k = w // PER_EDIT if length >= SHORT else 0
    return w, k, w + 1 - Q - Q * k


def align(item: np.ndarray, starts: np.ndarray, lengths: np.ndarray, text: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, most: int) -> np.ndarray:
    """The least edits (most + 1 if more) of each region item[start : start + length] inside text[low:high], on ``width`` diagonals from the one where ``start`` meets ``place``.

    All regions and their bands advance together, one item byte a step; a region over the budget goes. A region may begin and end anywhere in its text.
    """
    out = np.full(len(starts), most + 1, np.int64)
    band = np.arange(width, dtype=np.int16)
    far = np.int16(1 << 10)
    rows = np.arange(len(starts))
    at = places[:, None] + band[None, :]
    cost = np.where((at < low[:, None]) | (at > high[:, None]), far, np.int16(0))
    t = 0
    while len(rows):
        ended = lengths[rows] == t
        if ended.any():
            out[rows[ended]] = np.minimum(cost[ended].min(axis=1), most + 1)
        alive = ~ended if t % 4 else ~ended & (cost.min(axis=1) <= most)
        if not alive.all():
            rows, cost = rows[alive], cost[alive]
            if not len(rows):
                break
        at = places[rows, None] + (t + band)[None, :]
        lo, hi = low[rows, None], high[rows, None]
        inside = (at >= lo) & (at < hi)
        step = np.where(inside, cost + (text[np.clip(at, 0, len(text) - 1)] != item[starts[rows] + t][:, None]), far).astype(np.int16)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # an item byte that the text lacks
        step = np.minimum.accumulate(step - band, axis=1) + band  # text bytes that the item lacks
        step[(at + 1 < lo) | (at + 1 > hi)] = far
        cost = step
        t += 1
    return out


def leaks(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(number of the text, number of the item, edits, start of the region in the item, its length), once for each pair: the least edits, then the first region."""
    if not index.forms:
        return []
    form, at = normal(texts)
    codes = grams(form)
    hits = np.flatnonzero(index.seen[(codes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    rank = np.searchsorted(index.codes, codes[hits])
    known = index.codes[np.minimum(rank, len(index.codes) - 1)] == codes[hits]
    hits, rank = hits[known], rank[known]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    todo = [(0, len(index.forms), 0, len(hits))] if len(hits) else []
    while todo:
        i0, i1, h0, h1 = todo.pop()
        own = rank[h0:h1].astype(np.int64) << 32
        first, last = np.searchsorted(index.keys, own | i0), np.searchsorted(index.keys, own | i1)
        n = int((last - first).sum())
        if not n:
            continue
        low, high = int(hits[h0]), int(hits[h1 - 1])
        if n > MATCHES and i1 - i0 > 1:
            todo += [(i0, (i0 + i1) // 2, h0, h1), ((i0 + i1) // 2, i1, h0, h1)]
        elif n > MATCHES and high - low > 8 * WINDOW:
            # Halves overlap by more than any region and its edits.
            mid = (low + high) // 2
            todo += [(i0, i1, h0, h0 + int(np.searchsorted(hits[h0:h1], mid + 2 * WINDOW))), (i0, i1, h0 + int(np.searchsorted(hits[h0:h1], mid)), h1)]
        else:
            _count(index, form, at, hits[h0:h1], first, last, best)
    return [(x, y, *v) for (x, y), v in sorted(best.items())]


def _count(index: Index, form: np.ndarray, at: np.ndarray, hits: np.ndarray, first: np.ndarray, last: np.ndarray, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
    """Add the leaks among matches of the q-grams at ``hits`` with index rows ``first`` to ``last``."""
    n = last - first
    spread = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    place, item, j = np.repeat(hits, n), index.keys[spread] & 0xFFFFFFFF, index.place[spread].astype(np.int64)
    sizes = np.diff(index.begin)
    whole = (sizes[item] < SHORT) & (j == 0)
    for p, y in zip(place[whole].tolist(), item[whole].tolist()):
        f = index.forms[y]
        if form[p - 1] in (0, 32) and np.array_equal(form[p : p + len(f)], f) and form[p + len(f)] in (0, 32):
            best[int(np.searchsorted(at, p, side="right")) - 1, y] = (0, 0, len(f))
    long = sizes[item] >= SHORT
    place, item, j = place[long], item[long], j[long]
    text = np.searchsorted(at, place, side="right") - 1
    w, k, least = (np.array(x) for x in zip(*(budget(m) for m in sizes.tolist())))
    diagonal = place - j
    if not len(diagonal):
        return
    pair = text * len(sizes) + item
    lowest = int(diagonal.min())
    found: list[np.ndarray] = []
    for shift in (0, 1):  # bands overlap by half: k edits keep to one of them
        wide = 2 * (k[item] + 1)
        band = (diagonal - lowest + shift * (k[item] + 1)) // wide
        group = pair * (int(band.max()) + 1) + band
        bound = int(j.max()) + 1
        # One key sorts several times faster than two.
        order = np.argsort(group * bound + j) if (int(group.max()) + 1) < (1 << 62) // bound else np.lexsort((j, group))
        g, p = group[order], j[order]
        need = least[item[order]]
        end = np.arange(len(order)) + need - 1
        ok = end < len(order)
        end = np.where(ok, end, 0)
        ok &= (g[end] == g) & (p[end] - p <= w[item[order]] - Q)
        own = order[ok]
        i, p, q = item[own], p[ok], p[end[ok]]
        low, high = np.maximum(0, q + Q - w[i]), np.minimum(p, sizes[i] - w[i])
        mid = band[own] * wide[own] - shift * (k[i] + 1) + lowest
        fits = low <= high
        g, low, high = g[ok][fits], low[fits], high[fits]
        if len(g):
            # Window starts of a text, item and band; low and high ascend, so runs that touch are one.
            new = np.flatnonzero(np.concatenate([[True], (np.diff(g) != 0) | (low[1:] > high[:-1] + 1)]))
            found.append(np.stack([text[own][fits][new], i[fits][new], mid[fits][new], low[new], high[np.append(new[1:], len(g)) - 1]]))
    if not found:
        return
    runs = np.concatenate(found, axis=1)
    pieces = -(-(runs[4] - runs[3] + 1) // STARTS)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    t, i, mid, low, high = np.repeat(runs, pieces, axis=1)
    low = low + nth * STARTS
    high = np.minimum(high, low + STARTS - 1)
    size = high - low + 1
    shared = np.maximum(0, w[i] + 1 - size)
    todo = np.argsort(low, kind="stable")
    chunk = 256
    while len(todo):
        own, todo = todo[:chunk], todo[chunk:]
        chunk *= 4
        own = own[_edits(index, form, at, t[own], i[own], mid[own], high[own], shared[own], k) <= k[i[own]]]
        rows = np.repeat(own, size[own])
        start = low[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
        cost = _edits(index, form, at, t[rows], i[rows], mid[rows], start, w[i[rows]], k)
        good = cost <= k[i[rows]]
        rows, cost, start = rows[good], cost[good], start[good]
        # The best region of each text and item comes first.
        order = np.lexsort((start, cost, i[rows], t[rows]))
        rows, cost, start = rows[order], cost[order], start[order]
        new = np.ones(len(rows), bool)
        new[1:] = (np.diff(t[rows]) != 0) | (np.diff(i[rows]) != 0)
        rows, cost, start = rows[new], cost[new], start[new]
        for x, y, c, s, width in zip(t[rows].tolist(), i[rows].tolist(), cost.tolist(), start.tolist(), w[i[rows]].tolist()):
            if (x, y) not in best or (c, s, width) < best[x, y]:
                best[x, y] = (c, s, width)
        if best and len(todo):
            # Later starts can't be better than an exact region.
            exact = [best.get(pair, (1,))[:2] for pair in zip(t[todo].tolist(), i[todo].tolist())]
            todo = todo[[e[0] > 0 or e[1] > s for e, s in zip(exact, low[todo].tolist())]]


#: Weights of a hash of a stretch's bytes.
_WEIGHTS = np.random.default_rng(7).integers(1, 1 << 63, WINDOW, dtype=np.uint64)


def _alike(index: Index, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each stretch of the items' bytes the number of the first with equal bytes. They are sorted by a hash; one that differs from what it would stand for stands for itself."""
    column, last = np.arange(WINDOW), len(index.flat) - 1

    def stretch(rows: np.ndarray) -> np.ndarray:
        return np.where(column < length[rows, None], index.flat[np.minimum(begin[rows, None] + column, last)], np.uint8(0))

    parts = [np.arange(a, min(a + ALIGNED, len(begin))) for a in range(0, len(begin), ALIGNED)]
    hashed = np.concatenate([np.zeros(0, np.uint64), *(stretch(rows).astype(np.uint64) @ _WEIGHTS for rows in parts)])
    order = np.lexsort((hashed, length))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(hashed[order]) != 0) | (np.diff(length[order]) != 0)
    first = np.empty(len(order), np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    for rows in parts:
        rows = rows[first[rows] != rows]
        differ = rows[(stretch(rows) != stretch(first[rows])).any(axis=1)]
        first[differ] = differ
    return first


def _same(index: Index, begin: np.ndarray, length: np.ndarray, place: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each row the number of the first that aligns equal bytes of an item at the same place of the same text."""
    stretches, of = np.unique(begin * (WINDOW + 1) + length, return_inverse=True)
    bytes_of = _alike(index, stretches // (WINDOW + 1), stretches % (WINDOW + 1))[of]
    order = np.lexsort((bytes_of, place, text))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for column in (bytes_of, place, text):
        new[1:] |= np.diff(column[order]) != 0
    first = np.empty(len(order), np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    return first


def _edits(index: Index, form: np.ndarray, at: np.ndarray, t: np.ndarray, i: np.ndarray, mid: np.ndarray, start: np.ndarray, length: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Edits of items' stretches in their texts and bands. Equal stretches of several items at one place of the texts are aligned once."""
    out = np.zeros(len(t), np.int64)
    for most in np.unique(k[i]).tolist():
        every = np.flatnonzero(k[i] == most)
        first = _same(index, index.begin[i[every]] + start[every], length[every], mid[every] + start[every], t[every])
        rows = every[np.unique(first)]
        for a in range(0, len(rows), ALIGNED):
            r = rows[a : a + ALIGNED]
            out[r] = align(index.flat, index.begin[i[r]] + start[r], length[r], form, mid[r] + start[r] - most, at[t[r]], at[t[r] + 1] - 1, 4 * most + 3, most)
        out[every] = out[every[first]]
    return out


def index_blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the benchmark's blocks; the driver holds one block at a time."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    for i in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()
        yield make_index(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, item_start, length: a row for each document and item it leaks (normal form's places)."""
    schema = "doc_id long, item_id long, edits long, item_start long, length long"
    found = None
    for index in index_blocks(benchmark):
        known = docs.sparkSession.sparkContext.broadcast(index)

        def look(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for part, texts in common.slices(batches, "text"):
                ids = part.column(0).to_pylist()
                rows = [(ids[x], known.value.ids[y], *rest) for x, y, *rest in leaks(known.value, texts)]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "edits", "item_start", "length"])

        one = docs.select("doc_id", "text").mapInArrow(look, schema)
        found = one if found is None else found.unionByName(one)
    return found


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, unchanged."""
    for index in index_blocks(benchmark):
        known = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for part, texts in common.slices(batches, "text"):
                bad = {x for x, *_ in leaks(known.value, texts)}
                yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op6_decontaminate_qgram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
