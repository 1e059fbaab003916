"""Column functions over mapping rows ``m0 .. m{k-1}``."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import GraphView
from ..plans.query import Edge, QueryGraph


def m(u: int) -> str:
    return f"m{u}"


def injective(q: QueryGraph, u: int, mapped: list[int]) -> Column:
    """Vertex ``u`` differs from every mapped vertex of its label; other labels differ anyway."""
    return reduce(lambda x, w: x & (F.col(m(u)) != F.col(m(w))), [w for w in mapped if q.labels[w] == q.labels[u]], F.lit(True))


def all_distinct(q: QueryGraph) -> Column:
    return reduce(lambda x, u: x & injective(q, u, list(range(u))), range(q.size), F.lit(True))


def with_presence(rows: DataFrame, g: GraphView, q: QueryGraph, edges: list[Edge]) -> DataFrame:
    """``rows`` with a boolean ``p_a_b`` per query edge: whether its image is an edge."""
    for a, b in edges:
        found = g.edges_between(q.labels[a], q.labels[b], m(a), m(b)).withColumn(f"p_{a}_{b}", F.lit(True))
        rows = rows.join(found, [m(a), m(b)], "left").withColumn(f"p_{a}_{b}", F.col(f"p_{a}_{b}").isNotNull())
    return rows


def present_mask(q: QueryGraph) -> Column:
    """The preserved edges as bits, from the columns of ``with_presence``."""
    return reduce(lambda x, i: x + F.when(F.col(f"p_{q.edges[i][0]}_{q.edges[i][1]}"), F.lit(1 << i)).otherwise(F.lit(0)), range(len(q.edges)), F.lit(0).cast("long"))


def missing_of(mask: Column, q: QueryGraph) -> Column:
    return (F.lit(len(q.edges)) - F.bit_count(mask)).cast("int")


def keeps_connected(mask: Column, q: QueryGraph, threshold: int) -> Column:
    """The preserved edges are among the masks that keep the query connected within the budget."""
    return mask.isin(q.connected_masks(threshold))


def violations(rows: DataFrame, g: GraphView, q: QueryGraph, threshold: int) -> DataFrame:
    """One row of counts: mappings that break totality, labels, injectivity, the budget or connectivity, or repeat."""
    ids = [m(u) for u in range(q.size)]
    t = q.clamp(threshold)
    total = reduce(lambda x, c: x & F.col(c).isNotNull(), ids, F.lit(True))
    labelled = rows.withColumn("ok_label", F.lit(True))
    for u in range(q.size):
        right = g.with_label(q.labels[u], m(u)).withColumn("ok", F.lit(True))
        labelled = labelled.join(right, m(u), "left").withColumn("ok_label", F.col("ok_label") & F.col("ok").isNotNull()).drop("ok")
    distinct = F.size(F.array_distinct(F.array(*ids))) == q.size
    checked = with_presence(labelled, g, q, list(q.edges)).withColumn("mask", present_mask(q))
    count = lambda bad: F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).cast("long")
    connected = [q.mask(p) for level in q.lattice(q.cycle_rank) for p in level]
    one = checked.agg(
        count(~total).alias("not_total"), count(~F.col("ok_label")).alias("wrong_label"), count(~distinct).alias("not_injective"),
        count(missing_of(F.col("mask"), q) > t).alias("over_budget"), count(~F.col("mask").isin(connected)).alias("disconnected"), count(missing_of(F.col("mask"), q) != F.col("missing")).alias("wrong_missing"),
    )
    repeated = rows.groupBy(*ids).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("repeated"))
    return one.join(repeated)  # one row each
