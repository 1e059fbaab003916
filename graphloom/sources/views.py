"""Graph views over the relational tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import GraphView


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def returned_together(spark: SparkSession, sf_dir: str) -> GraphView:
    """Parts, labelled by brand, joined if an order returned both."""
    lines = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct()
    half = lines.withColumnRenamed("l_partkey", "a").join(lines.withColumnRenamed("l_partkey", "b"), "l_orderkey").where("a < b").select("a", "b")
    return GraphView.of(_read(spark, sf_dir, "part", "p_partkey", "p_brand").toDF("vid", "label"), half)


def trade(spark: SparkSession, sf_dir: str) -> GraphView:
    """Regions, nations, suppliers and customers (by segment); the kind is the low three bits of an id."""
    key = lambda c, kind: F.col(c).cast("long") * 8 + kind
    region, nation = _read(spark, sf_dir, "region", "r_regionkey"), _read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    supplier, customer = _read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    vtx = region.select(key("r_regionkey", 0).alias("vid"), F.lit("region").alias("label"))
    vtx = vtx.unionByName(nation.select(key("n_nationkey", 1).alias("vid"), F.lit("nation").alias("label")))
    vtx = vtx.unionByName(supplier.select(key("s_suppkey", 2).alias("vid"), F.lit("supplier").alias("label")))
    vtx = vtx.unionByName(customer.select(key("c_custkey", 3).alias("vid"), F.concat(F.lit("cust:"), "c_mktsegment").alias("label")))
    lines = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag").where("l_returnflag = 'R'")
    orders = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(key("o_custkey", 3).alias("a"), key("l_suppkey", 2).alias("b"))
    half = nation.select(key("n_nationkey", 1).alias("a"), key("n_regionkey", 0).alias("b"))
    half = half.unionByName(supplier.select(key("s_suppkey", 2).alias("a"), key("s_nationkey", 1).alias("b")))
    half = half.unionByName(customer.select(key("c_custkey", 3).alias("a"), key("c_nationkey", 1).alias("b")))
    return GraphView.of(vtx, half.unionByName(bought))


_views: dict[tuple, GraphView] = {}


def shared_view(spark: SparkSession, sf_dir: str, name: str = "returned_together") -> GraphView:
    """One view per session and folder, so that queries share the kept edge table."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _views:
        _views[key] = {"returned_together": returned_together, "trade": trade}[name](spark, sf_dir)
    return _views[key]


#: The same views for DuckDB.
SQL_VIEWS = {
    "returned_together": """vtx AS (SELECT p_partkey AS vid, p_brand AS label FROM part),
edge AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey
         WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R')""",
    "trade": """vtx AS (SELECT CAST(r_regionkey AS BIGINT) * 8 AS vid, 'region' AS label FROM region UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 1, 'nation' FROM nation
        UNION ALL SELECT s_suppkey * 8 + 2, 'supplier' FROM supplier UNION ALL SELECT c_custkey * 8 + 3, 'cust:' || c_mktsegment FROM customer),
half AS (SELECT CAST(n_nationkey AS BIGINT) * 8 + 1 AS a, CAST(n_regionkey AS BIGINT) * 8 AS b FROM nation UNION SELECT s_suppkey * 8 + 2, CAST(s_nationkey AS BIGINT) * 8 + 1 FROM supplier
         UNION SELECT c_custkey * 8 + 3, CAST(c_nationkey AS BIGINT) * 8 + 1 FROM customer
         UNION SELECT o_custkey * 8 + 3, l_suppkey * 8 + 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
edge AS (SELECT a AS src, b AS dst FROM half UNION SELECT b, a FROM half)""",
}
