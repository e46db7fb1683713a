"""Secret scans with multipart credential linking.

Three kinds of spans stand by themselves (``assign``, ``access``, ``hex``). Three weak kinds are only candidates: ``ident`` (an
assigned identifier), ``secret`` (a mixed token of 20 or more characters) and ``endpoint`` (a URL or a host with a port). An interval
join within a scope (a paragraph between blank lines) looks for complementary parts up to ``WINDOW`` characters away, from the end of one to the start of the next:
an ident counts beside a secret part, a secret beside an identifying part, an endpoint beside both. Other weak candidates
are not reported. An access span is an identifying part, assign and hex spans are secret parts. A mixed token may stand right after ``=``; one
that is an ident's own value is both parts.

The scan of texts is a Python regex in each Arrow batch; the interval join takes running extremes over rows dealt by document: the
largest end of the parts that start no later, and the least start of those that start no earlier.

A null or empty text has no spans but keeps its row. Repeated rows stay rows of their own. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm import common

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
BASE = 3
WINDOW = 256
#: Up to so many spans and masked texts are broadcast.
MASKED = 500_000

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A run that is long enough; shorter runs would be dropped, and runs of one class can't overlap.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENT = re.compile(r"""(?:client|account|user|key|app|tenant)[_-]?id["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}""", re.IGNORECASE | re.ASCII)
#: The lookbehind leaves one start a run, so the lookaheads need no bounds.
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}")
LONG = re.compile(r"[A-Za-z0-9+/_-]{20}")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}:\d{1,5}(?!\d)""", re.IGNORECASE | re.ASCII)
BLANK = re.compile(r"\n[\x20\t\r]*\n")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all parts; a weak part that touches a base span gives way to it."""
    found: list[tuple[int, int, int]] = []
    assigned = ":" in text or "=" in text
    if assigned:
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text)]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    weak: list[tuple[int, int, int]] = []
    if assigned and "id" in (low := text.lower()) and (":" in low or "=" in low):
        weak += [(3, *m.span()) for m in IDENT.finditer(text)]
    if LONG.search(text):
        weak += [(4, *m.span()) for m in SECRET.finditer(text)]
    if "://" in text or ":" in text:
        weak += [(5, *m.span()) for m in ENDPOINT.finditer(text)]
    taken = sorted((a, b) for _, a, b in found)
    ends: list[int] = []
    for _, b in taken:
        ends.append(max(b, ends[-1]) if ends else b)
    for kind, a, b in weak:
        i = bisect(taken, (b - 1, 1 << 60))
        if not i or ends[i - 1] <= a:
            found.append((kind, a, b))
    return found


def parts(docs: DataFrame) -> DataFrame:
    """A row for each part and one of kind -1 for each document: _row, doc_id, _hash (of the text), kind, start, end, scope."""
    named = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"), F.xxhash64("text").alias("_hash"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.slices(batches, "text"):
            rows: list[tuple] = []
            for doc_id, row, hashed, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), texts):
                rows.append((doc_id, row, hashed, -1, 0, 0, -1))
                if found := scan(text):
                    blanks = [m.start() for m in BLANK.finditer(text)] if "\n" in text else []
                    rows += [(doc_id, row, hashed, kind, a, b, bisect(blanks, a)) for kind, a, b in found]
            kinds = [pa.int64()] * 3 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "_row", "_hash", "kind", "start", "end", "scope"])

    return named.mapInArrow(look, "doc_id long, _row long, _hash long, kind int, start int, end int, scope int")


def linked(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """The document rows, base spans and those weak parts of parts() that have their complement near by."""
    scope = Window.partitionBy("_row", "scope")
    before, after = (scope.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("start"), F.desc("start")))
    kind = F.col("kind")
    near = lambda of: F.coalesce(F.col("start") - F.max(F.when(of, F.col("end"))).over(before) <= window, F.lit(False)) | F.coalesce(F.min(F.when(of, F.col("start"))).over(after) - F.col("end") <= window, F.lit(False))
    found = found.repartition("_row").withColumns({"_ids": near(kind.isin(1, 3)), "_secrets": near(kind.isin(0, 2, 4))})
    ids, secrets = F.col("_ids"), F.col("_secrets")
    keep = (kind < BASE) | ((kind == 3) & secrets) | ((kind == 4) & ids) | ((kind == 5) & ids & secrets)
    return found.filter(keep).drop("_ids", "_secrets")


def _listed(spans: F.Column) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, spans (an array of kind, start, end), counts of base kinds, and digests of their lists."""
    span = F.struct("start", "kind", "end")
    kind = F.col("kind")
    counts = [F.count_if(kind == i).alias(f"n_{KINDS[i]}") for i in range(BASE)]
    weak = F.count_if(kind >= BASE).alias("n_linked")
    kept = linked(parts(docs), window).groupBy("_row").agg(F.first("doc_id").alias("doc_id"), *counts, weak, F.collect_list(F.when(kind >= 0, span)).alias("_spans"))
    base = F.filter("_spans", lambda s: s["kind"] < BASE)
    names = F.array(*[F.lit(k) for k in KINDS])
    return kept.select("doc_id", *[f"n_{k}" for k in KINDS[:BASE]], "n_linked", F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"), F.transform(F.array_sort("_spans"), lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"))


def redact(docs: DataFrame, mask: str = "[SECRET]", window: int = WINDOW) -> DataFrame:
    """``docs`` with each stretch of reported spans replaced by ``mask``, and n_chars (if there) set anew. Only texts with spans change; other columns may have any names.

    Spans are found once for each (doc_id, text). Up to MASKED of such texts are broadcast by hash and place, so that texts stay where they are; beyond, they meet their rows
    in a shuffled null-safe equi-join. A text is cut in one pass, whatever the number of its spans.
    """
    found = linked(parts(docs), window).filter("kind >= 0").groupBy("doc_id", "_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    i, h, known, own = common.free_names(docs, "_id", "_h", "_spans", "_hash")
    spans = common.written(found.select(F.col("doc_id").alias(i), F.col("_hash").alias(h), F.col("spans").alias(known)), "spans")
    few = (spans.agg(F.sum(F.size(known) + 1)).first()[0] or 0) <= MASKED
    joined = docs.withColumn(own, F.xxhash64("text")).join(F.broadcast(spans) if few else spans, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(h)), "left").drop(i, h, own)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.slices(batches, "text"):
            names = part.schema.names
            listed = part.column(names.index(known)).to_pylist()
            columns = {n: part.column(k) for k, n in enumerate(names) if n != known}
            if any(listed):
                new = [_masked(t, s, mask) if s else t for t, s in zip(texts, listed)]
                old = columns["text"].is_null().to_pylist()
                columns["text"] = pa.array([None if null else t for t, null in zip(new, old)], pa.string())
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(new, listed, columns["n_chars"].to_pylist())], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return joined.mapInArrow(cut, docs.schema)


def _masked(text: str, spans: list[dict[str, int]], mask: str) -> str:
    at, out = 0, []
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], mask]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def op5_secrets_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")
