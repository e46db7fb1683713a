"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws an exponential number from a hash of the key and the
child's name, divided by the child's weight; the least draw wins. A child's draw depends on nothing but its own name and weight,
so a changed weight moves keys only between that child and its siblings, and only inside subtrees whose weights change.

The ``fleet`` tree holds whole regions of racks of shards up to ``base``; each shard beyond is a region of its own with its
own weight, so that adding one draws keys into it and moves nothing else. Balance is as good as hashing gives.

A null doc_id is one key of its own. A null text has no bytes and the CRC of no bytes. Repeated rows of a key share its shard; each has
its own slot. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm import common

SHARDS = 40
RACKS, PER_RACK = 4, 5
#: Blocks in which a shard's rows are numbered; a task sorts a block, never a shard.
BLOCKS = 256

Leaf = tuple[str, str, int, float]


def fleet(shards: int = SHARDS, base: int = SHARDS) -> list[Leaf]:
    """(region, rack, shard, weight) of each shard."""
    tree, region = [], RACKS * PER_RACK
    for s in range(shards):
        grouped = s < base
        tree.append((f"region{s // region}" if grouped else f"single{s}", f"rack{s % region // PER_RACK}" if grouped else "rack0", s, 1.0))
    return tree


def _draw(key: Column, path: str, children: dict[str, float]) -> Column:
    """The name of the child of ``path`` that ``key`` goes to."""
    draws = []
    for name, weight in sorted(children.items()):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{path}/{name}")), 11)
            draws.append(F.struct((-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(weight)).alias("draw"), F.lit(name).alias("name")))
    return F.array_min(F.array(*draws))["name"]


def _level(at: Column, key: Column, below: dict[str, dict[str, float]]) -> Column:
    found = None
    for path, children in sorted(below.items()):
        found = F.when(at == path, _draw(key, path, children)) if found is None else found.when(at == path, _draw(key, path, children))
    return found


def place(df: DataFrame, key: str, tree: list[Leaf], out: str) -> DataFrame:
    """``df`` with ``out_region``, ``out_rack`` and ``out`` (the shard's number) of each row's key."""
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[str, float]] = {}
    for region, rack, shard, weight in tree:
        if weight < 0:
            raise ValueError("weights are not negative")
        regions[region] = regions.get(region, 0) + weight
        racks.setdefault(region, {})[rack] = racks.get(region, {}).get(rack, 0) + weight
        shards.setdefault(f"{region}/{rack}", {})[str(shard)] = weight
    if not sum(regions.values()) > 0:
        raise ValueError("the tree has no weight")
    racks = {k: v for k, v in racks.items() if sum(v.values()) > 0}
    shards = {k: v for k, v in shards.items() if sum(v.values()) > 0}
    df = df.withColumn(f"{out}_region", _draw(F.col(key), "", regions))
    df = df.withColumn(f"{out}_rack", _level(F.col(f"{out}_region"), F.col(key), racks))
    return df.withColumn(out, _level(F.concat_ws("/", f"{out}_region", f"{out}_rack"), F.col(key), shards).cast("int"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, base: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, slot and the shard after growing by one.

    Slots are gapless in a shard: rows are numbered within (shard, block), and the counts of the shard's earlier blocks are added.
    Those counts have at most shards * BLOCKS rows, so they are broadcast.
    """
    own = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 16).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = place(place(own, "doc_id", fleet(shards, base), "shard"), "doc_id", fleet(shards + 1, base), "grown_shard")
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(BLOCKS)))
    counts = placed.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = placed.withColumn("_inside", inside).join(F.broadcast(offsets), ["shard", "_block"])
    return numbered.select("doc_id", "size", "text_crc32", F.col("shard_region").alias("region"), F.col("shard_rack").alias("rack"), "shard", (F.col("_before") + F.col("_inside")).alias("slot"), "grown_shard")


def op3_shard_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
