"""Token counts as delta-maintained rollups.

A batch of changes (insert, update, delete) becomes signed entries: an inserted row adds its counts, a deleted document takes back what
earlier batches added for its doc_id, an update does both. The batch's entries, added up by source, language and
tokenizer version, are its delta; totals are the sum of all deltas. Nothing is ever counted anew.

Commits are idempotent. A batch's entries are written first, its delta last; the batch is committed when its delta is whole (the
writer's success marker). A repeated commit of the same batch does nothing; one that failed midway is written over. Batches are committed in ascending order.

Entries lie in PARTS folders by a hash of doc_id, so a batch with deletes reads the folders of its ids alone. ``compact`` adds up the entries and deltas of all batches so far into one
table each, without what cancels out; later commits read that and the batches since.

A null text has no tokens but is a document. Null sources and languages are groups of their own. Repeated inserted rows count each; a delete takes back all rows
of its doc_id; a null doc_id can be inserted but never deleted, and unknown ids delete nothing. Empty batches commit an empty delta. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import common, textvec, tokens

COUNTED = "doc_id long, source string, lang string, tokenizer string, tokens long, chars long"
GROUP = ("source", "lang", "tokenizer")
BPE, WORDS = "byte_bpe_50k", "words"
KEPT = {"entries": f"{COUNTED}, sign long, part int", "deltas": "source string, lang string, tokenizer string, docs long, tokens long, chars long"}
#: Folders of a batch's entries.
PARTS = 64


def counts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Two rows for each document: its tokens by the byte-level BPE and its blank-separated words."""
    path = tokenizer_path or tokens.tokenizer_path()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.tokenizer(path)
        for part, texts in common.slices(batches, "text", tokens.SLICE_CHARS):
            found = [(BPE, [len(x) for x in known.encode(texts)]), (WORDS, np.diff(textvec.word_hashes(texts)[1]))]
            chars = pa.array([len(t) for t in texts], pa.int64())
            for name, n in found:
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([name] * len(texts)), pa.array(n, pa.int64()), chars], ["doc_id", "source", "lang", "tokenizer", "tokens", "chars"])

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(look, COUNTED)


def part_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(PARTS)).cast("int")


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def committed(self, batch: int) -> bool:
        return any(self._exists(f"{self.path}/{kind}/batch={batch}/_SUCCESS") for kind in ("deltas", "compact_deltas"))

    def _finished(self, kind: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        found = [int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(at) if s.getPath().getName().startswith("batch=")]
        return sorted(b for b in found if self._exists(f"{self.path}/{kind}/batch={b}/_SUCCESS"))

    def batches(self) -> list[int]:
        return self._finished("deltas")

    def _read(self, kind: str) -> DataFrame | None:
        """All that is committed: the last compaction and the batches since."""
        base = self._finished("compact_deltas")[-1:]
        tables = [(f"compact_{kind}", b) for b in base] + [(kind, b) for b in self.batches() if not base or b > base[0]]
        found = None
        for name, b in tables:
            one = self.spark.read.schema(KEPT[kind]).parquet(f"{self.path}/{name}/batch={b}")
            found = one if found is None else found.unionByName(one)
        return found

    def history(self, ids: DataFrame) -> DataFrame | None:
        """Entries of earlier batches in the folders that hold ``ids`` (doc_id)."""
        before = self._read("entries")
        if before is None:
            return None
        parts = [r[0] for r in ids.select(part_of(F.col("doc_id"))).distinct().collect()]
        return before.filter(F.col("part").isin(parts))

    def commit(self, batch: int, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Commit ``inserts`` (doc_id, source, lang, text) and ``deletes`` (doc_id); an update is in both. False if it was committed before."""
        if self.committed(batch):
            return False
        known = self.batches() or self._finished("compact_deltas")
        if known and batch < known[-1]:
            raise ValueError(f"batch {batch} comes after {known[-1]}")
        entries = self.spark.createDataFrame([], f"{COUNTED}, sign long")
        if inserts is not None:
            entries = entries.unionByName(counts(inserts).withColumn("sign", F.lit(1).cast("long")))
        if deletes is not None:
            # Deleted ids are distinct, so a hot id can't multiply; what is left of each document is added up before it is taken back.
            ids = common.written(deletes.select("doc_id").filter("doc_id is not null").distinct(), "deletes")
            before = self.history(ids)
            if before is not None:
                hit = before.join(ids, "doc_id", "left_semi")
                left = hit.groupBy("doc_id", *GROUP, "tokens", "chars").agg((-F.sum("sign")).alias("sign")).filter("sign < 0")
                entries = entries.unionByName(left)
        own = self._put(entries, "entries", batch)
        sums = [F.sum("sign").alias("docs"), *(F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("tokens", "chars"))]
        own.groupBy(*GROUP).agg(*sums).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        if deletes is not None:
            common.discard(ids)
        return True

    def _put(self, entries: DataFrame, kind: str, batch: int) -> DataFrame:
        """Entries in their folders; the hint lets Spark split large ones and put small ones together."""
        path = f"{self.path}/{kind}/batch={batch}"
        entries.withColumn("part", part_of(F.col("doc_id"))).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(path)
        return self.spark.read.schema(KEPT["entries"]).parquet(path)

    def compact(self) -> None:
        """One table of entries and one of deltas for all batches so far; what a failed compaction left is written over, and commits meanwhile aren't foreseen."""
        done = self.batches()
        if not done or done[-1] in self._finished("compact_deltas"):
            return
        left = self._read("entries").groupBy("doc_id", *GROUP, "tokens", "chars").agg(F.sum("sign").alias("sign")).filter("sign <> 0")
        self._put(left, "compact_entries", done[-1])
        self.totals().write.mode("overwrite").parquet(f"{self.path}/compact_deltas/batch={done[-1]}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, chars of what is in now."""
        found = self._read("deltas")
        if found is None:
            return self.spark.createDataFrame([], KEPT["deltas"])
        return found.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in ("docs", "tokens", "chars"))).filter("docs <> 0 or tokens <> 0")


def surplus_copies(docs: DataFrame) -> DataFrame:
    """doc_ids of documents whose whole text an earlier doc_id has (texts known by two 64-bit hashes)."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_a"), F.xxhash64(F.lit(1), "text").alias("_b")).filter("text is not null and doc_id is not null")
    first = common.written(keyed.groupBy("_a", "_b").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1"), "first")
    return common.hot_join(keyed, first, ["_a", "_b"], "_n", docs.count()).filter("doc_id <> _first").select("doc_id")


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, load them again (a repeated commit), then delete the surplus exact copies."""
    docs = common.table(spark, sf_dir, "documents")
    rollup = Rollup(spark, common.scratch_dir(spark, "rollup"))
    rollup.commit(1, inserts=docs)
    rollup.commit(1, inserts=docs)
    rollup.commit(2, deletes=surplus_copies(docs))
    return rollup.totals()
