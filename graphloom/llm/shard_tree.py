"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

Every node has a weight, the sum of its shards' weights.  A key descends from the root: at each
level every child draws ``-ln(u) / weight`` with ``u`` from a hash of key and node, and the least draw
wins.  Raising one child's weight can only make that child win more keys, so movement stays
within the subtree whose weight changed; a shard that opens a region of its own takes rows only
into itself, which is the ``key`` law.

Slots: rows alike in id, size and text checksum are one group, counted before the shuffle; the groups of a shard are dealt by a
hash into buckets of bounded size, given ranges of slots inside their bucket, and moved up by the rows of the buckets
before; a large group is written in parts.  No task holds a whole shard, or all rows of one id.

Defined cases: null text counts as empty (size 16, crc32 0); a null key hashes as a key of its own;
repeated rows go to one shard with different slots; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Groups of one (shard, bucket) that a task numbers at a time.
BUCKET_ROWS = 50_000
#: Rows of one group that a task writes at a time.
PART_ROWS = 10_000


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, regions: int = 4, racks: int = 2, per_rack: int = 5) -> list[Leaf]:
    """The base tree of regions x racks x shards; every shard beyond it opens a region of its own."""
    base = regions * racks * per_rack
    tree = [Leaf(s // (racks * per_rack), s // per_rack, s) for s in range(min(shards, base))]
    return tree + [Leaf(regions + i, regions * racks + i, base + i) for i in range(shards - base)]


def _uniform(key: Column, node: Column) -> Column:
    """A uniform number from the first 52 bits of a hash of key and node, never 0 or 1."""
    bits = F.conv(F.substring(F.md5(F.concat(key, node)), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def _choose(key: Column, level: str, children: Column) -> Column:
    """The child of least ``-ln(u) / weight``; ``children``: ``array<struct<id, w>>``."""
    draws = F.transform(children, lambda c: F.struct((-F.log(_uniform(key, F.concat(F.lit(f"/{level}"), c["id"].cast("string")))) / c["w"]).alias("d"), c["id"].alias("id")))
    return F.array_min(draws).getField("id")


def _children(leaves: list[Leaf], parent, child) -> Column:
    """A literal ``array<array<struct<id, w>>>``: at a parent's number its children and their weights."""
    found: dict[int, dict[int, float]] = {}
    for x in leaves:
        inner = found.setdefault(parent(x), {})
        inner[child(x)] = inner.get(child(x), 0.0) + x.weight
    lists = [F.array(*[F.struct(F.lit(i).alias("id"), F.lit(w).alias("w")) for i, w in sorted(found.get(p, {}).items())]) for p in range(max(found) + 1)]
    return F.array(*lists)


def place(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key: weighted draws at region, rack and shard level."""
    region = _choose(key, "region", F.get(_children(tree, lambda x: 0, lambda x: x.region), F.lit(0)))
    rack = _choose(key, "rack", F.get(_children(tree, lambda x: x.region, lambda x: x.rack), region))
    return _choose(key, "shard", F.get(_children(tree, lambda x: x.rack, lambda x: x.shard), rack)).cast("int")


def shard(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into a shard of ``tree``, with its gapless slot there and its shard in ``grown``."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    # Rows alike in all that is returned are one group, counted before the shuffle.
    groups, _ = common.write_shared(spark, rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), "groups")
    n, most = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    buckets = max(1, -(-n // (BUCKET_ROWS * len(tree))))
    k = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    of_bucket = F.concat_ws("/", k, "text_crc32", "size")
    placed = groups.withColumns({"shard": place(k, tree), "grown_shard": place(k, grown) if grown else F.lit(None).cast("int"), "bucket": F.floor(_uniform(of_bucket, F.lit("/bucket")) * buckets)})
    inside = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("start", F.sum("n").over(inside) - F.col("n"))
    if buckets > 1:
        counts = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
        before = (F.sum("rows").over(W.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("before")
        numbered = numbered.join(common.broadcast_if(counts.select("shard", "bucket", before), buckets * len(tree)), ["shard", "bucket"]).withColumn("start", F.col("before") + F.col("start"))
    if most > PART_ROWS:  # a large group is dealt out in parts, so that no task writes all of its rows
        first = F.explode(F.expr(f"sequence(0L, n - 1, {PART_ROWS}L)"))
        numbered = numbered.select("*", first.alias("first")).withColumns({"start": F.col("start") + F.col("first"), "n": F.least(F.col("n") - F.col("first"), F.lit(PART_ROWS))})
        numbered = numbered.repartition("doc_id", "text_crc32", "first")
    out = numbered.select("*", F.explode(F.expr("sequence(0L, n - 1)")).alias("i"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("i")).cast("long").alias("slot"), "grown_shard")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"), topology(40), topology(41))
