import math
import struct
import zlib
from collections import Counter

import xxhash

from gleanery.llm import sharding


def test_slots_and_sizes(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, 7, 7).collect()
    assert len(rows) == odd_docs.count()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    sizes = Counter((r.doc_id, r["size"], r.text_crc32) for r in rows)
    assert sizes == Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert sharding.shard_documents(no_docs).count() == 0


def test_growth_moves_rows_only_into_the_new_shard(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "cast(doc_id as string) text")
    rows = sharding.shard_documents(ids).collect()
    assert {r.shard for r in rows} == set(range(40))
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    moved = sum(r.grown_shard == 40 for r in rows)
    assert abs(moved - 20_000 / 41) < 5 * math.sqrt(20_000 / 41)
    counts = Counter(r.shard for r in rows)
    assert max(abs(n - 500) for n in counts.values()) < 5 * math.sqrt(500)


def test_changed_weight_moves_only_in_its_subtree(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    tree = sharding.fleet(40)
    heavier = [(r, k, s, 3.0 if s == 7 else w) for r, k, s, w in tree]
    # the region keeps its weight: another shard of the same rack gives way
    heavier = [(r, k, s, 0.0 if s in (5, 6) else w) for r, k, s, w in heavier]
    before = {r.doc_id: r for r in sharding.place(ids, "doc_id", tree, "shard").collect()}
    after = {r.doc_id: r for r in sharding.place(ids, "doc_id", heavier, "shard").collect()}
    for i, r in before.items():
        assert after[i].shard_region == r.shard_region and after[i].shard_rack == r.shard_rack
        if r.shard not in range(5, 10):
            assert after[i].shard == r.shard
    assert not any(r.shard in (5, 6) for r in after.values())


def drawn(key, path, children):
    """The child with the least draw; equal draws go by name."""
    best = None
    for name, weight in children.items():
        h = xxhash.xxh64_intdigest(f"{path}/{name}".encode(), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
        one = (-math.log(((h >> 11) + 0.5) / (1 << 53)) / weight, name)
        best = one if best is None or one < best else best
    return best[1]


def test_placement_equals_recomputation(spark):
    tree = [(r, k, s, 1.0 + s % 3) for r, k, s, _ in sharding.fleet(43, 40)]
    regions, racks, shards = Counter(), {}, {}
    for r, k, s, w in tree:
        regions[r] += w
        racks.setdefault(r, Counter())[k] += w
        shards.setdefault((r, k), {})[str(s)] = w
    for row in sharding.place(spark.range(400).withColumnRenamed("id", "doc_id"), "doc_id", tree, "shard").collect():
        region = drawn(row.doc_id, "", regions)
        rack = drawn(row.doc_id, region, racks[region])
        assert (row.shard_region, row.shard_rack, row.shard) == (region, rack, int(drawn(row.doc_id, f"{region}/{rack}", shards[region, rack])))
