"""Connected components of a table of links, by alternating stars on shuffled tables.

A round joins every node's neighbours to the least of them; nothing is gathered on the driver but
one count and one checksum a round.  A node with very many links is split by Spark's skew handling,
as the joined minima have one row per node.  Defined cases: no links give no rows; repeated links and self links
change nothing; null ends are dropped.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes that a step handles for a link, which it reads in both directions.
LINK_BYTES = 128


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over ``u, v``."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``u, v``: every linked node but each component's least, with that least."""
    size = LINK_BYTES * links.count()  # a round never has more links than the one before
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    links, path = common.write_shared(spark, links, "links", size)
    before = None
    while True:
        after, new = common.write_shared(spark, _stars(links), "links", size)
        common.drop_shared(spark, path)
        links, path = after, new
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return links
        before = state
