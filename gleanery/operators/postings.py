"""BM25 over several weighted fields by an inverted index of tables: postings by term, kept up to date by deltas, and a top-k that reads only the levels of postings that can reach it.

Tables under one folder, each row of a generation ``gen`` (0 is the base, an update adds one):

* ``forward``: id, length, terms (term, tf), alive: a row's own postings, so that an update can take back what it replaces; a deleted row isn't alive.
* ``postings``: bucket (a hash of the term, a folder), term, level, id, tf, length, sorted by term and level, so that Parquet's statistics skip what a query leaves out. ``level`` is the
  posting's saturated frequency in LEVELS steps, by the mean length of the base.
* ``levels``: term, level, n (signed), least and most tf and length: what a query needs to know of postings before it reads any.
* ``totals``: n and length of all rows (signed), and the mean length that levels go by.

A row's postings count where their generation is the row's last. A term's weight grows with tf and falls with length, so a level's extremes bound what its postings give. From the levels of its terms a query finds a score that at least k rows
reach, and with it the levels that can't lift a row there whatever else it holds; terms that can't do so together are read only for rows that others found. Scores and ranks are exact.

Tokens are runs of letters and digits, lower-cased; a query's terms are tokens (longer terms count token by token). tf is the sum of a token's counts in the fields times their weights, length all tokens of a row. Null fields are empty, rows
without a token count in the totals. Ids are unique; of repeated ids in one call the last by content stays. Two updates at once aren't foreseen; an update that failed leaves an unfinished generation that the next one overwrites.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import search
from gleanery.sources import tables

K1, B = 1.2, 0.75
LEVELS, BUCKETS = 16, 64
#: Postings that a task sorts and a file holds, about, and rows that are broadcast at most.
FILE_ROWS, BROADCAST_ROWS = 500_000, 500_000


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    fields: tuple[str, ...]
    weights: tuple[float, ...]

    def read(self, table: str) -> DataFrame:
        """All finished generations of a table."""
        last = self.last()
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/gen={g}" for g in range(last + 1)])

    def last(self) -> int:
        """The last finished generation; -1 before the first."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/totals")
        store = at.getFileSystem(conf)
        if not store.exists(at):
            return -1
        done = {int(s.getPath().getName()[4:]) for s in store.listStatus(at) if s.getPath().getName().startswith("gen=") and store.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))}
        return max(done, default=-1)


def tokens(field: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(field, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(entries: Column) -> Column:
    """Where the runs of one term begin in a sorted array, and its size at the end."""
    key = lambda i: F.get(entries, i)["term"]
    return F.concat(F.filter(F.sequence(F.lit(0), F.greatest(F.size(entries) - 1, F.lit(0))), lambda i: (i < F.size(entries)) & ((i == 0) | (key(i) != key(i - 1)))), F.array(F.size(entries)))


def forward(items: DataFrame, fields: tuple[str, ...], weights: tuple[float, ...]) -> DataFrame:
    """id, length, terms (term, tf) and alive of each row; of rows with one id the last by content.

    A row's tokens are counted in its own arrays, sorted, so a task holds one row's tokens at a time and none are shuffled.
    """
    own = items.groupBy("id").agg(F.max(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])).alias("_r")).select("id", "_r.*")
    marked = lambda f, i: F.transform(tokens(F.col(f)), lambda w: F.struct(w.alias("term"), F.lit(i).alias("field")))
    words = own.select("id", F.sort_array(F.concat(*[marked(f, i) for i, f in enumerate(fields)])).alias("_w"))
    runs = words.select("id", "_w", _runs(F.col("_w")).alias("_at"))
    weight = F.array(*[F.lit(float(x)) for x in weights])
    field = lambda k: F.get(F.col("_w"), k)["field"]
    held = lambda a, b, i: F.size(F.filter(F.sequence(a, b - 1), lambda k: field(k) == i))
    several = lambda a, b: sum((held(a, b, i) * F.get(weight, F.lit(i)) for i in range(len(weights))), F.lit(0.0))
    tf = lambda a, b: F.when(field(a) == field(b - 1), (b - a) * F.get(weight, field(a))).otherwise(several(a, b))
    terms = F.transform(F.slice("_at", F.lit(1), F.size("_at") - 1), lambda a, k: F.struct(F.get(F.col("_w"), a)["term"].alias("term"), tf(a, F.get(F.col("_at"), k + 1)).alias("tf")))
    return runs.select("id", F.size("_w").cast("long").alias("length"), terms.alias("terms"), F.lit(True).alias("alive"))


def _level(tf: Column, length: Column, mean: float) -> Column:
    return F.least(F.lit(LEVELS - 1), F.floor(LEVELS * tf / (tf + K1 * (1 - B + B * length / mean)))).cast("int")


def _postings(rows: DataFrame, mean: float) -> DataFrame:
    flat = rows.select("id", "length", F.inline("terms"))
    return flat.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"), "term", _level(F.col("tf"), F.col("length"), mean).alias("level"), "id", "tf", "length")


def _levels(postings: DataFrame, sign: int) -> DataFrame:
    return postings.groupBy("term", "level").agg((F.count("*") * sign).alias("n"), *[f(c).alias(f"{name}_{c}") for c in ("tf", "length") for name, f in (("least", F.min), ("most", F.max))])


def _add(index: Index, gen: int, rows: DataFrame, gone: DataFrame | None, mean: float | None) -> None:
    """Write a generation of forward rows; ``gone`` are the forward rows that they take the place of."""
    spark, at = index.spark, lambda table: f"{index.path}/{table}/gen={gen}"
    rows.write.mode("overwrite").parquet(at("forward"))
    rows = spark.read.schema(rows.schema).parquet(at("forward")).filter("alive")
    sums = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    new, old = sums(rows), None if gone is None else sums(gone)
    mean = max(1.0, new.length / max(1, new.n)) if mean is None else mean
    posted = _postings(rows, mean)
    # ranges down to the id: no bucket, and no term, has to fit one task
    order = ["bucket", "term", F.desc("level"), "id"]
    dealt = posted.repartitionByRange(max(1, math.ceil(new.postings / FILE_ROWS)), *order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
    levels = _levels(posted, 1) if gone is None else _levels(posted, 1).unionByName(_levels(_postings(gone, mean), -1))
    levels.write.mode("overwrite").parquet(at("levels"))
    total = (new.n - (old.n if old else 0), new.length - (old.length if old else 0), mean)
    spark.createDataFrame([total], "n long, length long, mean double").coalesce(1).write.mode("overwrite").parquet(at("totals"))


def build(items: DataFrame, path: str, fields: tuple[str, ...], weights: tuple[float, ...] = search.BM25_FIELDS) -> Index:
    """An index of ``items`` (id and the fields) in a new folder."""
    index = Index(items.sparkSession, path, tuple(fields), tuple(weights))
    if index.last() >= 0:
        raise ValueError(f"{path} holds an index")
    _add(index, 0, forward(items, index.fields, index.weights), None, None)
    return index


def _moved(index: Index) -> DataFrame:
    """id and last generation of rows that an update wrote."""
    return index.read("forward").filter("gen > 0").groupBy("id").agg(F.max("gen").alias("_gen"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast if it has few rows, as it is otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def live(index: Index, rows: DataFrame) -> DataFrame:
    """Those of ``rows`` (id, gen) whose generation is the last of their id."""
    if index.last() == 0:
        return rows
    met = rows.join(_small(_moved(index)), "id", "left")
    return met.filter(F.col("gen") == F.coalesce("_gen", F.lit(0))).drop("_gen")


def current(index: Index) -> DataFrame:
    """The forward rows there are now."""
    return live(index, index.read("forward")).filter("alive").select("id", "length", "terms", "alive")


def update(index: Index, items: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
    """Put ``items`` in the place of rows with their ids, and take back the rows of ``deleted`` (id); an id in both is put. Postings of other rows aren't touched."""
    known = current(index)
    rows = known.limit(0) if items is None else forward(items, index.fields, index.weights)
    rows = tables.written(rows, "rows")
    if deleted is not None:
        off = known.join(deleted.select("id").distinct(), "id", "left_semi").join(rows.select("id"), "id", "left_anti")
        rows = rows.unionByName(off.withColumn("alive", F.lit(False)))
    _add(index, index.last() + 1, rows, known.join(rows.select("id"), "id", "left_semi"), index.read("totals").filter("gen = 0").first()["mean"])


def compact(index: Index, path: str) -> Index:
    """The same index as one generation in a new folder, from the forward rows alone."""
    new = Index(index.spark, path, index.fields, index.weights)
    _add(new, 0, current(index), None, None)
    return new


def _gain(tf: float, length: float, mean: float) -> float:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


@dataclass(frozen=True)
class Plan:
    """What a query reads: a term's idf, the levels of each essential term that find rows, and the score that ``k`` rows reach."""

    idf: dict[str, float]
    finding: dict[str, list[int]]
    mean: float
    least: float
    whole: bool


def plan(index: Index, terms: list[str], k: int | None) -> Plan:
    """Bounds from the levels of the query's terms: at most LEVELS rows a term come to the driver."""
    total = index.read("totals").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    n, mean = total.n, max(1e-9, total.length / max(1, total.n))
    found = index.read("levels").filter(F.col("term").isin(terms)).groupBy("term", "level")
    rows = found.agg(F.sum("n").alias("n"), F.min("least_tf").alias("a"), F.max("most_tf").alias("b"), F.min("least_length").alias("c"), F.max("most_length").alias("d")).filter("n > 0").collect()
    idf = {t: max(1e-6, math.log((n - df + 0.5) / (df + 0.5))) for t in terms if (df := sum(r.n for r in rows if r.term == t))}
    high = {t: {r.level: idf[t] * _gain(r.b, r.c, mean) for r in rows if r.term == t} for t in idf}
    least = 0.0
    for t in idf if k is not None else ():
        there, reached = 0, math.inf
        for r in sorted((r for r in rows if r.term == t), key=lambda r: -r.level):
            there, reached = there + r.n, min(reached, idf[t] * _gain(r.a, r.d, mean))
            if there >= k:
                least = max(least, reached)
                break
    least *= 1 - 1e-9
    most = {t: max(levels.values()) for t, levels in high.items()}
    finding, together = {}, 0.0
    for t in sorted(most, key=lambda t: (most[t], t)):
        together += most[t]
        if together >= least:
            rest = sum(most.values()) - most[t]
            finding[t] = sorted(x for x, bound in high[t].items() if bound + rest >= least)
    whole = all(len(finding.get(t, ())) == len(levels) for t, levels in high.items())
    return Plan(idf, finding, mean, least, whole)


def scores(index: Index, terms: list[str], k: int | None = None) -> DataFrame:
    """id and bm25 of rows that hold a term: all of them, or, with ``k``, at least the best ``k``."""
    terms = list(dict.fromkeys(w for t in terms for w in re.findall(r"[^\W_]+", t.lower())))
    how = plan(index, terms, k) if terms else Plan({}, {}, 1.0, 0.0, True)
    known = sorted(how.idf)
    if not known:
        return index.read("forward").select("id").limit(0).withColumn("bm25", F.lit(0.0))
    buckets = [r[0] for r in index.spark.createDataFrame([(t,) for t in known], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).collect()]
    postings = live(index, index.read("postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(known)))
    if not how.whole:
        finds = F.lit(False)
        for t, levels in how.finding.items():
            finds = finds | ((F.col("term") == t) & F.col("level").isin(levels))
        postings = postings.join(postings.filter(finds).select("id").distinct(), "id", "left_semi")
    tf = F.col("tf")
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / how.mean))
    parts = (F.coalesce(F.max(F.when(F.col("term") == t, gain)), F.lit(0.0)) * how.idf[t] for t in known)
    return postings.groupBy("id").agg(sum(parts, F.lit(0.0)).alias("bm25"))


def top(index: Index, terms: list[str], k: int) -> DataFrame:
    """id, bm25 and rank of the best ``k`` rows."""
    return search.ranked(scores(index, terms, k), [F.desc("bm25"), F.asc("id")], k)
