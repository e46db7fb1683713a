"""Fill-in-middle transformation by a table-driven byte DFA.

A text is cut into units, each a run of blanks with the word after it (blanks at the end are a unit of their own). Two draws from a
hash of the document's number give the cuts before and after the middle, two more the form: ``psm`` is prefix, suffix, middle, ``spm``
suffix, prefix, middle, each part after its sentinel, ``plain`` the text itself. A text that holds a sentinel stays plain, so
every output can be turned back (``restore``).

One scan of the bytes does it all. Its states say whether the last byte was a blank, in a word, or part of a sentinel, and how many continuation
bytes a character still wants. A transition emits three things that are counted: a code point begins, a unit begins, a
sentinel ends. The state after a byte depends on the four bytes up to it at most, and the first byte of a text starts anew, so a batch of texts is scanned as lanes
of ``LANE`` bytes side by side, each with four bytes of run-up. The second pass looks the cuts up: the place of a
document's k-th unit, and the code points before it.

A null text is empty; an empty text is plain with no units. A null doc_id is hashed as an empty string. In a text that isn't valid UTF-8, a byte that continues nothing is a
code point of its own; it is kept as it is. Repeated rows are rows of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import common

#: Fixed values of the contract.
SEED = 42
FORM_PERCENT, SPM_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLANKS = b"\t\n\v\f\r "

#: Bytes of a lane of the scan.
LANE = 256
RUN_UP = 4
#: Bytes of the texts that are scanned together.
SCAN_BYTES = 1_000_000

START, BLANK, WORD, OPEN, NAMED, WANT1, WANT2, WANT3 = range(8)
STATES = 8
POINT, UNIT, SENTINEL = 1, 2, 4
#: Symbols are bytes; those of a text's first byte are a second alphabet that forgets the state.
SYMBOLS = 512
FIRST = 256


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """The next state and what is emitted, by state * SYMBOLS + symbol."""
    step, emit = np.zeros((STATES, SYMBOLS), np.uint8), np.zeros((STATES, SYMBOLS), np.uint8)
    names = {ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)}
    for state in range(STATES):
        for byte in range(256):
            continues = 0x80 <= byte < 0xC0
            if continues and state in (WANT1, WANT2, WANT3):
                to, out = (WORD, WANT1, WANT2)[state - WANT1], 0
            elif byte in BLANKS:
                to, out = BLANK, POINT | (0 if state == BLANK else UNIT)
            else:
                to = WANT1 if 0xC0 <= byte < 0xE0 else WANT2 if 0xE0 <= byte < 0xF0 else WANT3 if 0xF0 <= byte < 0xF8 else WORD
                to = OPEN if byte == ord("<") else NAMED if state == OPEN and byte in names else to
                out = POINT | (UNIT if state == START else 0) | (SENTINEL if state == NAMED and byte == ord(">") else 0)
            step[state, byte], emit[state, byte] = to, out
    step[:, FIRST:], emit[:, FIRST:] = step[START, :FIRST], emit[START, :FIRST]
    return step.reshape(-1), emit.reshape(-1)


STEP, EMIT = automaton()


def scan(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What the automaton emits at each byte of ``data``, in which texts begin at ``starts`` (the first of them at 0)."""
    n = len(data)
    lanes = -(-n // LANE)
    symbols = np.full(RUN_UP + lanes * LANE, FIRST, np.uint16)
    symbols[RUN_UP : RUN_UP + n] = data
    symbols[RUN_UP + starts[starts < n]] += FIRST
    grid = np.lib.stride_tricks.sliding_window_view(symbols, RUN_UP + LANE)[::LANE].T
    state = np.full(lanes, START, np.uint16)
    out = np.zeros((LANE, lanes), np.uint8)
    for k in range(RUN_UP + LANE):
        at = state * np.uint16(SYMBOLS) + grid[k]
        if k >= RUN_UP:
            EMIT.take(at, out=out[k - RUN_UP])
        state = STEP.take(at).astype(np.uint16)
    return out.T.reshape(-1)[:n]


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def cut_points(data: np.ndarray, ends: np.ndarray, ids: list[int | None], seed: int = SEED, form_percent: int = FORM_PERCENT, spm_percent: int = SPM_PERCENT) -> list[tuple]:
    """(units, form, bytes before the first cut, before the second, code points of the prefix, of the middle) of each text of ``data``."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    emitted = scan(data, starts) if len(data) else np.zeros(0, np.uint8)
    units = np.flatnonzero(emitted & UNIT)
    points = np.flatnonzero(emitted & POINT)
    marks = np.flatnonzero(emitted & SENTINEL)
    counted = {name: (np.searchsorted(of, starts), np.searchsorted(of, ends)) for name, of in (("unit", units), ("mark", marks))}
    found = []
    for k, (start, end, doc_id) in enumerate(zip(starts.tolist(), ends.tolist(), ids)):
        first, last = int(counted["unit"][0][k]), int(counted["unit"][1][k])
        n = last - first
        h1, h2, h3, h4 = draws(doc_id, seed)
        if start == end or counted["mark"][0][k] != counted["mark"][1][k] or h3 % 100 >= form_percent:
            found.append((n, "plain", None, None, None, None))
            continue
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        one, two = (int(units[first + c]) if c < n else end for c in (low, high))
        before = np.searchsorted(points, (start, one, two)).tolist()
        found.append((n, "spm" if h4 % 100 < spm_percent else "psm", one - start, two - start, before[1] - before[0], before[2] - before[1]))
    return found


def transform(docs: DataFrame, *, seed: int = SEED, form_percent: int = FORM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars and ``output``, the text in its form."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            cuts = cut_points(np.frombuffer(b"".join(texts), np.uint8), ends, ids, seed, form_percent, spm_percent)
            output = []
            for text, (_, form, one, two, _, _) in zip(texts, cuts):
                if form == "psm":
                    text = b"".join((p, text[:one], s, text[two:], m, text[one:two]))
                elif form == "spm":
                    text = b"".join((s, text[two:], p, text[:one], m, text[one:two]))
                output.append(text)
            columns = [ids, *([c[i] for c in cuts] for i in (0, 1, 4, 5)), output]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(look, schema).withColumn("output", F.col("output").cast("string"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > SCAN_BYTES:
                yield ids[start:i], texts[start:i]
                start, size = i, 0
            size += len(t)
        if ids[start:]:
            yield ids[start:], texts[start:]


def restore(output: Column, form: Column) -> Column:
    """The text's bytes from output and form alone. Sentinels are looked for from the left; none can stand in a part or across two."""
    data, width, rest = output.cast("binary"), len(PREFIX), F.lit(2**31 - 1)

    def parts(mark: str) -> list[Column]:
        one, two = (F.octet_length(F.substring_index(output, m, 1)) for m in (mark, MIDDLE))
        return [F.substring(data, F.lit(width + 1), one - width), F.substring(data, one + width + 1, two - one - width), F.substring(data, two + width + 1, rest)]

    psm, spm = parts(SUFFIX), parts(PREFIX)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(data)


def op11_fill_middle_dfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transform(common.table(spark, sf_dir, "documents"))
    restored = restore(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


_BLANK = "\\x20\\x09-\\x0D"
#: The contract as DuckDB says it, with no automaton.
SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi FROM u),
p AS (SELECT *, array_to_string(units[1:lo], '') AS a, array_to_string(units[lo + 1:hi], '') AS m, array_to_string(units[hi + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
