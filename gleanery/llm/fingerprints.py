"""Document fingerprints: bottom-k sketches of word shingles, with DataFrame and SQL functions alone.

A text's shingles are its runs of ``WORDS`` words (A-Z and other capitals lower-cased); with fewer words, the whole sequence is one. Its fingerprint
holds the ``K`` smallest distinct 64-bit hashes of them, in ascending order. Sketches of parts merge to the sketch of the whole: the smallest K of their union. The
share of the union's smallest K that both have estimates resemblance, and the place of the K-th smallest on the line of all hashes estimates the number of distinct
shingles (which is exact below K); the two together give containment.

A text is folded stretch by stretch (``STRETCH`` characters), so that one stretch's words are in memory, not a very long text's: the last words of a stretch, its
last one perhaps incomplete, go in front of the next.

``neighbours`` gives each document the next one in descending doc_id without a task that sees them all: approximate percentiles of
doc_id, which are ids of documents, end ranges; the first document of a range is copied to the range before it. Texts are shuffled once.

A null or empty text has no shingles and an empty fingerprint; two empty ones are alike (1.0), an empty and another aren't (0.0). A document without a
doc_id has no place in the order: it is nobody's next, and its own next is an empty text. Rows of one doc_id follow each other by hash of their text. A single document is its own next.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm import common

K = 128
WORDS = 5
STRETCH = 1_000_000
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Ranges for each shuffle partition of the session.
RANGES = 4
SKETCH = "array<bigint>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def _shingle_hashes(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` of the array ``words``."""
    runs = lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.lit(0), F.size(h) - (n - 1))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, n)]))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def sketch(text: Column, k: int = K, n: int = WORDS, stretch: int = STRETCH) -> Column:
    """The bottom-k sketch of ``text``."""
    text = F.coalesce(text, F.lit(""))
    stretches = F.greatest(F.lit(1), F.ceil(F.length(text) / stretch).cast("int"))
    words_of = lambda s: F.filter(F.split(F.lower(s), BLANKS), lambda w: w != "")
    state = lambda carry, kept: F.struct(carry.alias("carry"), kept.alias("kept"))

    def whole(words: Column) -> Column:
        """The hashes of the last words of a text; with fewer than ``n`` in all, one of the whole sequence."""
        return F.when(F.size(words) >= n, _shingle_hashes(words, n)).when(F.size(words) > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast(SKETCH))

    def step(acc: Column, i: Column) -> Column:
        piece = F.concat(acc["carry"], F.substring(text, i * stretch + 1, F.lit(stretch)))

        def more(piece: Column) -> Column:
            tail = lambda words: F.concat(F.concat_ws(" ", F.slice(words, F.greatest(F.lit(1), F.size(words) - (n - 1)), F.lit(n))), F.when(piece.rlike("[\\x20\\x09-\\x0D]$"), " ").otherwise(""))
            complete = lambda words: F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - 1))
            return _let(words_of(piece), lambda words: state(tail(words), smallest(F.concat(acc["kept"], _shingle_hashes(complete(words), n)), k)))

        return F.when(i == stretches - 1, state(piece, acc["kept"])).otherwise(_let(piece, more))

    start = state(F.lit(""), F.array().cast(SKETCH))
    finish = lambda acc: smallest(F.concat(acc["kept"], _let(words_of(acc["carry"]), whole)), k)
    return F.aggregate(F.sequence(F.lit(0), stretches - 1), start, step, finish)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return smallest(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """An estimate of the Jaccard similarity of two sketched sets."""
    alike = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0).when(F.least(F.size(a), F.size(b)) == 0, 0.0).otherwise(_let(merged(a, b, k), alike))


def distinct_count(a: Column, k: int = K) -> Column:
    """An estimate of the number of distinct shingles; exact below ``k``."""
    place = (F.get(a, F.lit(k - 1)).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """An estimate of how much of ``a``'s set is in ``b``'s: the intersection, by resemblance and the size of the union, over the size of ``a``."""
    share = resemblance(a, b, k) * distinct_count(merged(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), share))


def merge_parts(parts: DataFrame, keys: list[str], hashes: str, k: int = K) -> DataFrame:
    """One sketch for each key from any number of sketches: distinct hashes, of which each task keeps the least ``k`` of a key before the shuffle.

    A null or empty sketch adds nothing; a key with no hash at all has an empty sketch.
    """
    value = F.explode_outer(hashes).alias("_hash")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_hash")))
    kept = parts.select(*keys, value).distinct().withColumn("_rank", rank).filter(F.col("_rank") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(hashes))


def written_out(a: Column) -> Column:
    """A sketch as a string, 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def read_back(fingerprint: Column) -> Column:
    """The sketch of a string of written_out()."""
    places = F.sequence(F.lit(0), (F.octet_length(fingerprint) / 16).cast("int") - 1)
    value = lambda i: F.conv(F.substring(fingerprint, i * 16 + 1, F.lit(16)), 16, -10).cast("long")
    return F.when(F.octet_length(fingerprint) == 0, F.array().cast(SKETCH)).otherwise(F.transform(places, value))


def _listed(bounds: list[int]) -> Column:
    """A constant array; one of many numbers is quicker made from a string."""
    return F.split(F.lit(",".join(map(str, bounds))), ",").cast(SKETCH) if bounds else F.array().cast(SKETCH)


def _before(bounds: list[int], value: Column) -> Column:
    """How many of the ascending ``bounds`` are less than ``value``, by halving."""
    steps = max(1, len(bounds)).bit_length()
    listed = _listed(bounds)
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    return F.aggregate(halves, F.lit(0), lambda at, h: F.when((at + h <= len(bounds)) & (F.get(listed, at + h - 1) < value), at + h).otherwise(at))


def neighbours(docs: DataFrame, ranges: int | None = None, **extra: Column) -> DataFrame:
    """doc_id, text and next_text; of each column in ``extra``, computed from a row once its range has been shuffled, that of the row and of the next one (``next_`` before its name)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = ranges or RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [(i + 1) / n for i in range(n)], F.lit(max(10_000, 20 * n))).alias("p"), F.max(F.col("doc_id").cast("long")).alias("m")).first()
    bounds = sorted({*(ends.p or []), ends.m} - {None})
    place = lambda range_, turn, copy: F.struct(range_.cast("int").alias("_range"), F.lit(turn).alias("_turn"), F.lit(copy).alias("_copy"))
    at = F.col("_at")
    is_end = F.get(_listed(bounds), at) == F.col("doc_id")
    places = F.filter(F.array(place(at, 0, False), F.when(is_end & (at < len(bounds) - 1), place(at + 1, 0, True)), F.when(is_end & (at == len(bounds) - 1), place(F.lit(0), 1, True))), lambda p: p.isNotNull())
    dealt = own.filter("doc_id is not null").withColumn("_at", _before(bounds, F.col("doc_id"))).select("doc_id", "text", F.inline(places)).repartition("_range")
    order = Window.partitionBy("_range").orderBy("_turn", F.desc("doc_id"), F.xxhash64("text"), "text")
    named = {"text": F.col("text")} | extra
    shown = dealt.withColumns(extra).withColumns({f"next_{c}": F.lead(c).over(order) for c in named}).filter(~F.col("_copy")).drop("_range", "_turn", "_copy")
    loose = own.filter("doc_id is null").withColumnRenamed("text", "_own").withColumn("text", F.lit("")).withColumns(extra)
    loose = loose.withColumnsRenamed({c: f"next_{c}" for c in named}).withColumnRenamed("_own", "text").withColumns(extra)
    return shown.unionByName(loose)


def with_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """neighbours() with the sketch of each document, of its edited text and of the next document, and that edited text."""
    near = neighbours(docs, sketch=sketch(F.col("text"), k)).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.call_function("div", F.col("n_chars"), F.lit(3)).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    return near.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), k))


def op13_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_edits(common.table(spark, sf_dir, "documents"))
    mine = F.col("sketch")
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written_out(mine).alias("fingerprint"), written_out(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(mine, F.col("edited_sketch")).alias("near_edited"), resemblance(mine, F.col("next_sketch")).alias("near_next"),
    )
