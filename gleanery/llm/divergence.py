"""Source divergence audit: how far the term distributions of the sources of a language lie apart, in exact integers.

Terms are runs of letters (A-Z lower-cased, and every code point beyond ASCII). A language keeps the terms of at least ``MIN_DOCS`` of its documents. A term's share in a
group (language, source) is smoothed and scaled, p = 1 + floor(SCALE * (count + 5) / (N + 5 V)), where N is the group's count over all
kept terms and V the number of those. Two sources diverge by the sum of abs(p - q) over the kept terms; a source's own terms are
those whose share is above the language's.

Count columns are deduplicated: most terms of a long tail have one of few sparse vectors of (source, count), so terms are grouped by that
vector, each pair of sources is evaluated once for each distinct vector and multiplied by its multiplicity. What a pair's zero counts give is
added once for all V terms and taken off for the vectors seen, so absent terms cost nothing. Only the ranked lists go back to the original terms.

How it spreads: tasks count terms in bounded dictionaries, one shuffle by (language, term) adds them up and gives the vectors, and the kept ones are
written. Sources are dealt into blocks of about ``BLOCK``, distinct vectors into chunks of about ``CHUNK``; a task evaluates one pair of blocks over one chunk,
with arrays of at most 2 BLOCK columns. Shares of a hot group reach its terms by broadcast (at most common.HOT_SHARE groups), the others by a shuffled join.

Null text, lang and source are empty strings. A text without terms adds none, but its group is there: with no kept terms every pair's value is 0.
A language with one source has no pairs. Repeated rows count as documents of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm import common

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTH = 5
#: Entries of a task's dictionaries before they are passed on.
ENTRIES = 200_000
BLOCK = 128
CHUNK = 4096
#: Bytes to blanks but for letters and bytes of other code points; A-Z to a-z.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: added up within tasks, a row or more for each."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (total, holders) in counts.items():
                terms = list(total)
                n = len(terms)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.binary()), pa.array(total.values(), pa.int64()), pa.array(map(holders.__getitem__, terms), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])
            counts.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total, holders = counts.setdefault((lang, source), (Counter(), Counter()))
                held -= len(total)
                found = terms_of(text)
                total.update(found)
                holders.update(set(found))
                held += len(total)
                if held > ENTRIES:
                    yield from passed_on()
                    held = 0
        yield from passed_on()

    own = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return own.mapInArrow(look, "lang string, source string, term binary, count long, docs long")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term and its vector, an array of (source, count) by source, of the terms kept."""
    dealt = partial_counts(docs).repartition("lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    vectors = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "count"))).alias("vector"))
    return vectors.filter(F.col("docs") >= min_docs).select("lang", F.col("term").cast("string").alias("term"), "vector")


def share(count: Column, n: Column, v: Column) -> Column:
    """p, an integer; the product has 38 decimal digits of room."""
    whole = F.lit(SCALE).cast("decimal(18,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return F.call_function("div", whole, (n + SMOOTH * v).cast("decimal(20,0)")) + 1


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every occurring lang and source with n, v (of the language), lang_n, and seen (kept terms with a count)."""
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x["count"])).alias("lang_n"))
    sums = kept.select("lang", F.inline("vector")).groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("seen"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *map(zero, ("n", "v", "lang_n", "seen")))


def _shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """As share(), on arrays; where 64 bits are too few, with Python's integers."""
    if counts.size and int(counts.max()) > 9_000_000_000:
        counts, n = counts.astype(object), n.astype(object)
    return ((SCALE * (counts + SMOOTH)) // (n + SMOOTH * v) + 1).astype(np.int64)


def pair_values(kept: DataFrame, groups: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """lang, source, item (the other source) and value, for every two sources of a language, both ways round."""
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.max("v") / chunk)).alias("chunks"), F.max("v").alias("terms"))
    block_of = lambda source: F.pmod(F.xxhash64(source), F.col("blocks"))
    numbers = lambda count: F.sequence(F.lit(0).cast("long"), F.col(count) - 1)

    def pairs_of(own: Column) -> Column:
        """The pairs of blocks with one in the array ``own``."""
        return F.array_distinct(F.flatten(F.transform(own, lambda o: F.transform(numbers("blocks"), lambda b: F.struct(F.least(b, o).alias("a"), F.greatest(b, o).alias("b"))))))

    total = sizes.agg(F.sum("terms")).first()[0] or 0
    distinct = common.hot_join(kept, sizes, ["lang"], "terms", total).groupBy("lang", "blocks", "chunks", "vector").agg(F.count("*").alias("m"))
    owned = F.array_distinct(F.transform("vector", lambda x: block_of(x["source"])))
    parts = distinct.select("lang", "blocks", "vector", "m", F.pmod(F.xxhash64("vector"), "chunks").alias("chunk"), F.inline(pairs_of(owned)))
    inside = F.filter("vector", lambda x: block_of(x["source"]).isin(F.col("a"), F.col("b")))
    parts = parts.select("lang", "chunk", "a", "b", inside.alias("vector"), "m")
    members = groups.join(sizes, "lang").withColumn("own", block_of(F.col("source")))
    members = members.withColumn("chunk", F.explode(numbers("chunks"))).select("lang", "chunk", "source", "n", "v", "own", F.inline(pairs_of(F.array("own"))))

    def evaluate(vectors: pa.Table, sources: pa.Table) -> pa.Table:
        order = pc.sort_indices(sources.column("source"))
        sources = sources.take(order)
        names, n, own = sources.column("source").combine_chunks(), sources.column("n").to_numpy(), sources.column("own").to_numpy()
        lang, a, b = (sources.column(c)[0].as_py() for c in ("lang", "a", "b"))
        v, first = sources.column("v")[0].as_py(), sources.column("chunk")[0].as_py() == 0
        zero = _shares(np.zeros(len(n), np.int64), n, v) if v else np.zeros(len(n), np.int64)
        listed = vectors.column("vector").combine_chunks() if vectors.num_rows else None
        multiplicity = vectors.column("m").to_numpy() if vectors.num_rows else np.zeros(0, np.int64)
        shares = np.repeat(zero[None, :], len(multiplicity), 0)
        if listed is not None:
            flat = listed.flatten()
            where = pc.index_in(flat.field("source"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
            shares[row, where] = _shares(flat.field("count").to_numpy(), n[where], v)
        rows: list[tuple[np.ndarray, int, np.ndarray]] = []
        weight = int(multiplicity.sum())
        for i in range(len(n)):
            # each pair is evaluated in one pair of blocks: within one block, or across the two
            other = np.flatnonzero((np.arange(len(n)) > i) & ((own[i] != own) if a != b else True))
            if len(other):
                apart = multiplicity @ np.abs(shares[:, [i]] - shares[:, other]) if len(multiplicity) else np.zeros(len(other), np.int64)
                rows.append((np.full(len(other), i), other, apart + ((v if first else 0) - weight) * np.abs(zero[i] - zero[other])))
        if not rows:
            return pa.table({"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
        one, two, value = (np.concatenate(c) for c in zip(*rows))
        return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": names.take(pa.array(one)), "item": names.take(pa.array(two)), "value": pa.array(value, pa.int64())})

    keys = ["lang", "chunk", "a", "b"]
    found = parts.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(evaluate, "lang string, source string, item string, value long")
    summed = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return summed.select("lang", F.inline(ways), "value")


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a kept term) and value, where the group's share is above the language's."""
    rows = kept.select("lang", "term", F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x["count"]).alias("all"), F.inline("vector"))
    total = groups.agg(F.sum("seen")).first()[0] or 0
    joined = common.hot_join(rows, groups, ["lang", "source"], "seen", total)
    value = share(F.col("count"), F.col("n"), F.col("v")) - share(F.col("all"), F.col("lang_n"), F.col("v"))
    return joined.select("lang", "source", F.col("term").alias("item"), value.alias("value")).filter("value > 0")


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: all other sources by divergence, and the ``top`` terms of each source."""
    kept = common.written(kept_terms(docs, min_docs), "kept")
    groups = common.written(group_sizes(docs, kept), "groups")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    part = lambda df, name: df.withColumn("rank", F.row_number().over(ranked)).select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    pairs, terms = part(pair_values(kept, groups), "pair"), part(term_values(kept, groups), "term").filter(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op12_divergence_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


#: The contract as DuckDB says it: every term for every pair, with no vectors.
SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT w.lang, w.source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN n ON g.lang = n.lang AND g.source = n.source GROUP BY g.lang, g.source),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (gn.n + 5 * v) AS p FROM gn JOIN k ON gn.lang = k.lang JOIN v ON v.lang = k.lang LEFT JOIN n ON n.lang = k.lang AND n.source = gn.source AND n.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5)) // (max(ln) + 5 * max(v)) AS q FROM n JOIN (SELECT lang, sum(c) AS ln FROM n GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms) WHERE part = 'pair' OR rank <= 50"""
