"""N-gram Jaccard join by signature trees: which documents share enough of their word shingles, and what they are linked to.

Exact throughout: every pair of different texts whose shingle sets have ``100 * intersection >= percent * union`` is in one component.

1. Each document becomes its set of shingle hashes. Equal sets are one class from here on; one row's text stands for the class.
2. Candidates. In any order of all shingles, two linked sets share one of their first n - ceil(percent n / 100) + 1, so these are a set's keys. The order is by hash, but
   shingles that a bounded sample shows to be common come last, which bears on speed only. Keys held by the same classes are one bucket: a
   key is replaced by a hash of all its holders, and repeats go before bitmaps move.
3. Signature trees. The sets that share a key form a tree whose nodes hold OR-combined token bitmaps, size ranges and the most tokens that share a bit. Two nodes are walked at
   once: a pair goes when the sizes can't link, when common bits plus shared-bit tokens are below the least overlap, or when all below is connected already. First trees over the
   sets of each bucket, with bitmaps alone, give edges that span what is possible; their connected components are the candidate groups.
4. Then trees over each group's sets, with true intersections at the leaves, give links.
5. Links found are joined into components; a component's id is its least doc_id.

A bucket or group of many sets is dealt into blocks (of BLOCK sets or BLOCK_SHINGLES shingles). Each block meets itself and the first one. What these links leave apart from the largest
component of its bucket or group then meets every block: linear in the size of a group of near copies, whatever its size, and still every pair that isn't connected yet.
Keys of many holders are told by a sample and dealt into blocks at once, so no task counts them.

Sets and nodes are known by 64-bit hashes, a class's row by doc_id and a 64-bit hash of its text. Null and empty texts have no shingles and are linked with nothing; a repeated row is a
document of its own, equal to its copy. A row without a doc_id takes part and links others; its own component_id is the least doc_id of its component, null if that has none. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.llm import common, components, textvec

WORDS, PERCENT = 4, 85
#: Common shingles and keys are looked for in this many documents or classes: those in at least COMMON of them.
SAMPLE, COMMON = 4000, 8
#: Sets and shingles in a block, sets in a leaf of a signature tree, children of a node.
BLOCK, BLOCK_SHINGLES, LEAF, FANOUT = 2048, 1 << 22, 32, 8
#: Bits of the widest token bitmap.
LARGEST_MAP = 1 << 16
#: Up to so many rows of ids are broadcast; beyond, they meet the other side in a shuffled join.
BROADCAST_IDS = 500_000


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """The least intersection of linked sets of n and m shingles."""
    return -(-percent * (n + m) // (100 + percent))


def candidate_keys(tokens: np.ndarray, common_tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of a set (sorted hashes) such that any two different linked sets share one."""
    n = len(tokens)
    if n == 0 or 100 * (n - 1) < percent * n and 100 * n < percent * (n + 1):  # linked with equal sets alone
        return np.zeros(0, np.uint64)
    most = n - -(-percent * n // 100) + 1
    if len(common_tokens):
        at = np.minimum(np.searchsorted(common_tokens, tokens), len(common_tokens) - 1)
        frequent = common_tokens[at] == tokens
        rare = tokens[~frequent][:most]
        return rare if len(rare) == most else np.concatenate([rare, tokens[frequent][: most - len(rare)]])
    return tokens[:most]


def common_shingles(docs: DataFrame, words: int = WORDS, sample: int = SAMPLE, least: int = COMMON) -> np.ndarray:
    """Sorted hashes of shingles in at least ``least`` of ``sample`` documents (chosen by a hash of doc_id); it bears on speed only.

    At most sample / least of a document's mean size come back, so the list is bounded.
    """
    ids = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi").limit(sample)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *textvec.shingle_sets(texts, words)]).view(np.int64))], ["shingle"])

    rows = chosen.mapInArrow(shingles, "shingle long").groupBy("shingle").count().filter(F.col("count") >= least).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))


def set_hash(tokens: np.ndarray) -> int:
    """A hash of a set as a signed 64-bit number."""
    return int(textvec.mix(textvec.mix(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])


def document_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_a and set_b (hashes of the set), map (its token bitmap) and keys: a row for each document."""
    stop = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.slices(batches, "text"):
            sets = textvec.shingle_sets(texts, words)
            keys = [np.sort(candidate_keys(s, stop.value, percent)) for s in sets]
            b = np.array([textvec.mix(s ^ np.uint64(textvec.BASE)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
            sizes = np.array([len(s) for s in sets], np.int64)
            ends = np.cumsum([0, *(len(k) for k in keys)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))
            maps = pa.array([token_map(x, bits_of(len(x))).tobytes() for x in sets], pa.binary())
            columns = [part.column(0), part.column(2), pa.array(sizes), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array(b.view(np.int64)), maps, listed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "map", "keys"])

    named = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return named.mapInArrow(look, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, map binary, keys array<long>")


def bits_of(n: int) -> int:
    """Bits of the token bitmap of a set of ``n``."""
    return min(LARGEST_MAP, max(256, 1 << (2 * n - 1).bit_length()))


def token_map(tokens: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(bits, bool)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


def folded(token_map: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of more bytes as one of ``size`` bytes: a token's bit is its hash modulo the bits, so halves are combined."""
    while len(token_map) > size:
        half = len(token_map) // 2
        token_map = token_map[:half] | token_map[half:]
    return token_map


class Tree:
    """Signature tree over sets, given by bitmaps (rows of bytes, all of one width) and sizes: levels of nodes from leaves up."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, tie: np.ndarray):
        self.order = np.lexsort((tie, (np.log(np.maximum(1, sizes)) * 6).astype(int)))
        self.maps = np.ascontiguousarray(maps[self.order]).view(np.uint64)
        self.sizes = sizes[self.order]
        self.slack = self.sizes - np.bitwise_count(self.maps).sum(1).astype(np.int64)
        self.levels = [self.group(self.maps, self.sizes, self.sizes, self.slack, LEAF, np.arange(len(sizes) + 1))]
        while len(self.levels[-1]["low"]) > 1:
            below = self.levels[-1]
            self.levels.append(self.group(below["maps"], below["low"], below["high"], below["slack"], FANOUT, below["rows"]))

    @staticmethod
    def group(maps, low, high, slack, width, rows) -> dict[str, np.ndarray]:
        at = np.arange(0, len(low), width)
        return {"maps": np.bitwise_or.reduceat(maps, at, axis=0), "low": np.minimum.reduceat(low, at), "high": np.maximum.reduceat(high, at), "slack": np.maximum.reduceat(slack, at), "rows": np.append(rows[at], rows[-1])}


def connect(one: Tree, two: Tree | None, linked: Callable[[int, int, int], bool], percent: int = PERCENT, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all that links between two trees, or within one, connect.

    ``linked(i, j, least)`` decides on pairs that the bitmaps leave (numbers of sets; those of the second tree come after the first's), given their least overlap.
    Sets of equal ``labels`` are connected from the start.
    """
    within = two is None
    two = one if within else two
    shift = 0 if within else len(one.sizes)
    root = np.arange(shift + len(two.sizes)) if labels is None else np.unique(np.array(labels), return_inverse=True)[1]
    row_a, row_b = one.order, two.order + shift
    links: list[tuple[int, int]] = []
    stack = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        na, nb = one.levels[la], two.levels[lb]
        low_a, low_b = na["low"][a], nb["low"][b]
        if 100 * na["high"][a] < percent * low_b or 100 * nb["high"][b] < percent * low_a:
            continue
        if np.bitwise_count(na["maps"][a] & nb["maps"][b]).sum() + min(na["slack"][a], nb["slack"][b]) < -(-percent * (low_a + low_b) // (100 + percent)):
            continue
        ra, rb = slice(na["rows"][a], na["rows"][a + 1]), slice(nb["rows"][b], nb["rows"][b + 1])
        roots_a, roots_b = root[row_a[ra]], root[row_b[rb]]
        if roots_a[0] == roots_b[0] and (roots_a == roots_a[0]).all() and (roots_b == roots_b[0]).all():
            continue
        same = within and la == lb and a == b
        if la or lb:
            wide_a = range(a * FANOUT, min((a + 1) * FANOUT, len(one.levels[la - 1]["low"]))) if la else [a]
            wide_b = range(b * FANOUT, min((b + 1) * FANOUT, len(two.levels[lb - 1]["low"]))) if lb else [b]
            below = [(max(0, la - 1), x, max(0, lb - 1), y) for x in wide_a for y in wide_b if not same or x <= y]
            stack += sorted(below, key=lambda p: p[1] == p[3])  # equal numbers last, so they come first
            continue
        overlap = np.bitwise_count(one.maps[ra][:, None, :] & two.maps[rb][None, :, :]).sum(-1, dtype=np.int64) + np.minimum(one.slack[ra][:, None], two.slack[rb][None, :])
        least = -(-percent * (one.sizes[ra][:, None] + two.sizes[rb][None, :]) // (100 + percent))
        for x, y in zip(*np.nonzero((overlap >= least) & (roots_a[:, None] != roots_b[None, :]))):
            i, j = int(row_a[ra.start + x]), int(row_b[rb.start + y])
            if root[i] != root[j] and not (same and x >= y) and linked(i, j, int(least[x, y])):
                root[root == root[j]] = root[i]
                links.append((i, j))
    return links


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (numbers in left + right) that connect all that true links between left and right, or within left alone, connect."""
    every = left + (right or [])
    bits = bits_of(max((len(s) for s in every), default=1))

    def tree(sets: list[np.ndarray]) -> Tree:
        return Tree(np.array([token_map(s, bits) for s in sets]), np.array([len(s) for s in sets]), np.array([s[0] if len(s) else 0 for s in sets], np.uint64))

    return connect(tree(left), None if right is None else tree(right), lambda i, j, least: len(np.intersect1d(every[i], every[j], assume_unique=True)) >= least, percent, labels)


def possible_pairs(sizes: list[list[int]], maps: list[list[bytes]], percent: int = PERCENT, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """The same for sets known by their sizes and bitmaps alone: pairs count as linked when the bitmaps allow it. One or two sides.

    Sets whose sizes are apart by powers of two have trees of their own, so no wide bitmap is folded to the width of a much smaller set.
    """
    single, shift = len(sizes) == 1, len(sizes[0])
    bands: list[dict[int, list[int]]] = [{}, {}]
    for side, own in enumerate(sizes):
        for i, n in enumerate(own):
            bands[side].setdefault(n.bit_length() - 1, []).append(i)

    def tree(side: int, rows: list[int], width: int) -> Tree:
        m = np.array([folded(np.frombuffer(maps[side][i], np.uint8), width) for i in rows])
        return Tree(m, np.array([sizes[side][i] for i in rows]), np.ascontiguousarray(m[:, :8]).view(np.uint64)[:, 0])

    found: list[tuple[int, int]] = []
    other = 0 if single else 1
    for c, left in bands[0].items():
        for d, right in bands[other].items():
            if single and d < c or 100 * ((2 << min(c, d)) - 1) < percent << max(c, d):
                continue
            within = single and c == d
            every = left if within else left + [i + (0 if single else shift) for i in right]
            if len(every) > 1:
                width = min(*(len(maps[0][i]) for i in left), *(len(maps[other][i]) for i in right), LARGEST_MAP)
                pairs = connect(tree(0, left, width), None if within else tree(other, right, width), lambda i, j, least: True, percent, labels and [labels[i] for i in every])
                found += [(every[i], every[j]) for i, j in pairs]
    return found


def _pair_possible(n: int, one: bytes, m: int, two: bytes, percent: int) -> bool:
    """possible_pairs for two sets, which most buckets are."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    if len(one) != len(two):
        width = min(len(one), len(two))
        one, two = (folded(np.frombuffer(x, np.uint8), width).tobytes() for x in (one, two))
    a, b = int.from_bytes(one, "little"), int.from_bytes(two, "little")
    return (a & b).bit_count() + min(n - a.bit_count(), m - b.bit_count()) >= least_overlap(n, m, percent)


def _small(df: DataFrame) -> DataFrame:
    """``df`` (a written table) marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


PLACE = ("key", "one", "two", "side", "node", "label")


def _first_places(members: DataFrame) -> DataFrame:
    """Where each of ``members`` (key, node, blocks) is walked: its block with itself (one = two), and with the key's first block."""
    own = members.withColumn("_b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    zero = F.lit(0)
    place = lambda one, two, side: F.struct(one.alias("one"), two.alias("two"), side.alias("side"))
    first = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda k: place(zero, k, zero))
    other = F.array(place(F.col("_b"), F.col("_b"), zero), place(zero, F.col("_b"), F.lit(1)))
    return own.withColumn("_p", F.explode(F.when(F.col("_b") == 0, first).otherwise(other))).select("key", "_p.*", "node", F.col("node").alias("label"))


def _left_places(labelled: DataFrame) -> DataFrame:
    """Where rows (key, node, blocks, label) of keys of several blocks are walked again: what isn't in a key's largest component meets all blocks of the key."""
    counted = labelled.groupBy("key", "label").agg(F.count("*").alias("n"), F.first("blocks").alias("blocks"))
    odd = F.sum("n") - F.max("n")
    keys = counted.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.ceil(odd * F.first("blocks") / F.sum("n")).cast("int").alias("odd"))
    rows = labelled.join(_small(common.written(keys.filter("odd > 0"), "odd")), "key")
    place = lambda one, two, side: F.struct((-1 - one).alias("one"), two.alias("two"), F.lit(side).alias("side"))
    block, own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("odd")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("odd") - 1), lambda k: place(k, block, 1))
    asks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: place(own, k, 0))
    return rows.withColumn("_p", F.explode(F.when(F.col("label") == F.col("major"), met).otherwise(F.concat(met, asks)))).select("key", "_p.*", "node", "label")


def _connected(members: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root): components of all that ``links`` finds between members (key, node, blocks) of equal keys."""
    first = common.written(links(_first_places(members)), "links")
    joined = components.components(first)
    large = members.filter("blocks > 1")
    if large.isEmpty():
        common.discard(first)
        return joined
    labelled = common.written(large.join(joined, "node", "left").select("key", "node", "blocks", F.coalesce("root", "node").alias("label")), "labelled")
    second = common.written(links(_left_places(labelled)), "links")
    common.discard(labelled)
    if second.isEmpty():
        return joined
    out = components.components(first.union(second))
    common.discard(first, second, joined)
    return out


def _met(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "side", "node")


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple[bool, list[list[tuple]]]]:
    """Whether a group of equal (key, one, two) is within one block, and its two sides' rows (node, label, ...), each node once. Only one group is held."""
    for (_, one, two), members in groupby(rows, key=lambda r: r[:3]):
        sides: list[list[tuple]] = [[], []]
        for row in members:
            side = sides[row[3]]
            if not side or side[-1][0] != row[4]:
                side.append(row[4:])
        yield one == two, sides


def _edges(pairs: Iterator[tuple[int, int]], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    found: set[tuple[int, int]] = set()
    for a, b in pairs:
        found.add((a, b) if a < b else (b, a))
        if len(found) >= most:
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])
            found = set()
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(key, node, blocks): the buckets of classes (set_a, keys) that hold more than one class, and their members.

    Keys in at least COMMON of SAMPLE classes are buckets at once, their blocks told by their share of the sample. All others are counted, those of one class go, and those
    of the same classes become one.
    """
    keyed = classes.select(F.col("set_a").alias("node"), F.explode("keys").alias("key"))
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("set_a"), "set_a").limit(SAMPLE).select(F.explode("keys").alias("key"))
    share = F.col("n") * (1.25 * total / min(SAMPLE, max(1, total)) / BLOCK)
    hot = common.written(sample.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON).select("key", F.ceil(share).cast("int").alias("blocks")), "hot")
    hot_rows = keyed.join(F.broadcast(hot), "key").select("key", "node", "blocks")
    key = Window.partitionBy("key")
    counted = keyed.join(F.broadcast(hot), "key", "left_anti").select("key", "node", F.count("*").over(key).alias("n"), F.bit_xor(F.xxhash64("node")).over(key).alias("_x"), F.sum(F.xxhash64(F.lit(7), "node").bitwiseAND(0xFFFFFFFF)).over(key).alias("_s"))
    bucket = F.xxhash64("n", "_x", "_s").alias("key")
    rows = counted.filter("n > 1").select(bucket, "node", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).distinct()
    return rows.unionByName(hot_rows)


def candidate_groups(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root): groups of classes that hold every link, from the keys they share and what their bitmaps allow."""
    known = classes.select(F.col("set_a").alias("node"), F.col("n_shingles").cast("int").alias("n"), "map")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(8))))

        def pairs() -> Iterator[tuple[int, int]]:
            for within, (left, right) in _grouped(rows):
                if within and len(left) == 2:
                    (a, _, n, one), (b, _, m, two) = left
                    if _pair_possible(n, one, m, two, percent):
                        yield a, b
                elif len(left) > 1 if within else left and right:
                    sides = [left] if within else [left, right]
                    every = [r for side in sides for r in side]
                    for i, j in possible_pairs([[r[2] for r in side] for side in sides], [[r[3] for r in side] for side in sides], percent, [r[1] for r in every]):
                        yield every[i][0], every[j][0]

        return _edges(pairs())

    buckets = common.written(shared_buckets(classes), "buckets")
    out = _connected(buckets, lambda places: _met(places.join(known, "node").select(*PLACE, "n", "map")).mapInArrow(walk, "a long, b long"))
    common.discard(buckets)
    return out


def true_links(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked within each group of rows (key, one, two, side, node, label, text)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part, texts in common.slices(batches, "text") for row in zip(*(part.column(i).to_pylist() for i in range(6)), textvec.shingle_sets(texts, words)))

        def pairs() -> Iterator[tuple[int, int]]:
            for within, (left, right) in _grouped(rows):
                if len(left) > 1 if within else left and right:
                    every = left if within else left + right
                    for i, j in linked_pairs([r[2] for r in left], None if within else [r[2] for r in right], percent, [r[1] for r in every]):
                        yield every[i][0], every[j][0]

        return _edges(pairs())

    return rows.mapInArrow(walk, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, set_a and root (equal for documents of one component): a row for each document."""
    docs = docs.select("doc_id", "text")
    sets = common.written(document_sets(docs, words, percent), "sets")
    least = F.min(F.struct(F.isnull("doc_id"), "doc_id", "text_hash")).alias("rep")
    classes = sets.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(least, F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("map").alias("map"), F.first("keys").alias("keys"))
    classes = common.written(classes, "classes")
    named = common.written(sets.drop("keys", "map", "set_b"), "named")
    common.discard(sets)
    reps = common.written(classes.select(F.col("set_a").alias("node"), "rep.doc_id", "rep.text_hash", "n_shingles", "copies"), "reps")
    groups = candidate_groups(classes, percent)
    common.discard(classes)

    # Texts of the groups' classes meet again in blocks of their group.
    blocks = groups.join(reps, "node").groupBy("root").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    members = common.written(groups.join(blocks, "root").select(F.col("root").alias("key"), "node", "blocks"), "members")

    def links(places: DataFrame) -> DataFrame:
        wanted = common.written(places.join(reps.select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")), "node"), "places")
        text = docs.withColumn("_th", F.xxhash64("text")).join(_small(wanted), (F.col("_th") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        return true_links(_met(text.select(*PLACE, "text")), words, percent)

    joined = _connected(members, links)
    common.discard(members, groups)
    own = common.written(joined.join(reps.select("node", "doc_id"), "node"), "own")
    least = common.written(own.groupBy("root").agg(F.count("*").alias("n"), F.min("doc_id").alias("component")), "least")
    component = common.hot_join(own, least, ["root"], "n", own.count()).select("node", "root", "component", F.lit(True).alias("linked"))
    found = reps.join(component, "node", "left").select("node", "copies", F.coalesce("root", "node").alias("root"), F.when(F.col("linked"), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    found = common.written(found, "found")
    common.discard(joined, own, least)
    columns = ["doc_id", "text_hash", "n_shingles", "component_id", "set_a", "root"]
    of_set = found.select(F.col("node").alias("set_a"), "copies", "root", "component_id")
    full = common.hot_join(named.filter("n_shingles > 0"), of_set, ["set_a"], "copies", named.count()).select(columns)
    return full.unionByName(named.filter("n_shingles = 0").select(*columns[:3], F.col("doc_id").alias("component_id"), "set_a", F.lit(None).cast("long").alias("root")))


def op7_ngram_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, the one whose doc_id is least (rows without one come last, then the least hash of the text); its columns stay.

    Rows without shingles stay. Of rows with equal doc_id and text, one stays, the first by the plain columns. Any columns may be there besides, of any names. The rows that go are known by doc_id and a hash of the
    text; up to BROADCAST_IDS of them are broadcast, beyond that they meet the documents in a shuffled anti-join.
    """
    near = common.written(near_duplicates(docs, words, percent).filter("n_shingles > 0").select("root", F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash").alias("row")), "near")
    rows = common.written(near.groupBy("root", "row").agg(F.count("*").alias("n")), "rows")
    best = common.written(rows.groupBy("root").agg(F.min("row").alias("best"), F.count("*").alias("size")), "best")
    h, i, a, n = common.free_names(docs, "_text_hash", "_doc_id", "_hash", "_n")
    judged = common.written(common.hot_join(rows, best, ["root"], "size", rows.count()).filter("n > 1 or row <> best").select(F.col("row.doc_id").alias(i), F.col("row.text_hash").alias(a), (F.col("row") == F.col("best")).alias(n)).distinct(), "judged")
    common.discard(near, rows, best)
    known = docs.withColumn(h, F.xxhash64("text"))
    same = (F.col(h) == F.col(a)) & F.col("doc_id").eqNullSafe(F.col(i))
    kept = known.join(_small(judged), same, "left_anti").select(docs.columns)
    several = judged.filter(F.col(n))
    if several.isEmpty():
        return kept
    order = [c for c, t in docs.dtypes if not t.startswith(("map", "struct", "array", "variant"))]
    repeated = known.join(_small(several), same).withColumn(n, F.row_number().over(Window.partitionBy(i, a).orderBy(*[F.col(f"`{c}`") for c in order]))).filter(F.col(n) == 1)
    return kept.unionByName(repeated.select(docs.columns))
