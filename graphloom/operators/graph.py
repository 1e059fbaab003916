"""Data graphs as two tables: ``vtx(vid, label)`` and ``edge(src, dst)`` with both directions of every edge."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_edges(half: DataFrame) -> DataFrame:
    """Distinct undirected edges of ``a, b`` rows without self loops, in both directions; rows with nulls are dropped."""
    kept = half.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return kept.select(both.alias("e")).select("e.src", "e.dst")


@dataclass
class GraphView:
    """A labelled undirected simple graph.  ``typed`` is the edge table with both labels, kept once computed."""

    vtx: DataFrame
    edge: DataFrame
    _typed: DataFrame | None = field(default=None, repr=False)

    @staticmethod
    def of(vtx: DataFrame, half: DataFrame) -> GraphView:
        return GraphView(vtx.select(F.col("vid").cast("long").alias("vid"), "label").distinct(), canonical_edges(half.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))))

    def check(self) -> GraphView:
        """Raise if a vertex has two labels or an edge names a vertex that is not there."""
        if self.vtx.groupBy("vid").count().where("count > 1").take(1):
            raise ValueError("a vertex has several labels")
        if self.edge.join(self.vtx, F.col("src") == F.col("vid"), "left_anti").take(1):
            raise ValueError("an edge names a vertex that is not there")
        return self

    @property
    def typed(self) -> DataFrame:
        """``src, dst, sl, dl``: a join per end, then kept in memory or on disk, since every step of a plan reads it."""
        if self._typed is None:
            one = self.edge.join(self.vtx.select(F.col("vid").alias("src"), F.col("label").alias("sl")), "src")
            two = one.join(self.vtx.select(F.col("vid").alias("dst"), F.col("label").alias("dl")), "dst")
            self._typed = two.select("src", "dst", "sl", "dl").persist(StorageLevel.MEMORY_AND_DISK)
        return self._typed

    def edges_between(self, a: str, b: str, src: str, dst: str) -> DataFrame:
        """The edges from label ``a`` to label ``b`` as columns ``src, dst``."""
        return self.typed.where((F.col("sl") == a) & (F.col("dl") == b)).select(F.col("src").alias(src), F.col("dst").alias(dst))

    def with_label(self, label: str, name: str) -> DataFrame:
        return self.vtx.where(F.col("label") == label).select(F.col("vid").alias(name))

    def neighbours(self, vertices: DataFrame, vid: str = "vid") -> DataFrame:
        """``vertices`` with every neighbour as ``nbr``."""
        return vertices.join(self.edge.select(F.col("src").alias(vid), F.col("dst").alias("nbr")), vid)

    def has_edge(self, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
        """``pairs`` with ``present``: whether the edge exists."""
        probe = self.edge.select(F.col("src").alias(a), F.col("dst").alias(b), F.lit(True).alias("present"))
        return pairs.join(probe, [a, b], "left").withColumn("present", F.coalesce("present", F.lit(False)))

    def adjacency(self) -> DataFrame:
        """``vid, nbrs``: sorted neighbour lists, partitioned by vertex (a vertex's list is bounded by its degree)."""
        return self.edge.groupBy(F.col("src").alias("vid")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))

    def label_codes(self) -> DataFrame:
        """``label, code``: a dense code per label in label order."""
        ranks = self.vtx.select("label").distinct()
        from pyspark.sql import Window

        return ranks.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("code"))  # one row per label

    def describe(self) -> DataFrame:
        """One row: vertices, directed edges, largest degree, labels."""
        degrees = self.edge.groupBy("src").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("max_degree"))
        n = self.vtx.agg(F.count(F.lit(1)).alias("vertices"), F.countDistinct("label").alias("labels"))
        m = self.edge.agg(F.count(F.lit(1)).alias("directed_edges"))
        return n.join(m).join(degrees).select("vertices", "directed_edges", "max_degree", "labels")  # one row each


def fold(expressions: list[Column], start: Column) -> Column:
    for e in expressions:
        start = start + e
    return start
