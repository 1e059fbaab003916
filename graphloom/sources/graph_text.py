"""The line-oriented graph text format.

``t # id`` starts a graph, ``v id label`` is a vertex, ``e u v [label]`` an undirected edge whose label is not
used.  What stands before the first header is skipped, a second header ends the graph, blank lines are skipped; any
other line is an error.  Self loops and repeated or reversed edges have no effect.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import GraphView
from ..plans.query import QueryGraph


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the first graph, split, found by position; a file may be read in many splits."""
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w"), at.alias("at"))
    heads = lines.where("w[0] = 't'")
    first = heads.where("size(w) = 3").agg(F.min("at")).first()[0]
    if first is None:
        raise ValueError("the file has no graph header")
    lit = lambda x: F.struct(F.lit(x.path).alias("path"), F.lit(x.start).cast("long").alias("start"), F.lit(x.i).cast("long").alias("i"))
    second = heads.where(F.col("at") > lit(first)).agg(F.min("at")).first()[0]
    kept = lines.where(F.col("at") > lit(first))
    return (kept if second is None else kept.where(F.col("at") < lit(second))).where("w[0] <> ''").select("w")


def _checked(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path)
    number = r"^[0-9]+$"
    vertex = (F.col("w")[0] == "v") & (F.size("w") == 3) & F.get("w", F.lit(1)).rlike(number)
    edge = (F.col("w")[0] == "e") & F.size("w").isin(3, 4) & F.get("w", F.lit(1)).rlike(number) & F.get("w", F.lit(2)).rlike(number)
    bad = rows.where(~F.coalesce(vertex | edge, F.lit(False))).take(1)
    if bad:
        raise ValueError(f"not a graph line: {' '.join(bad[0].w)}")
    return rows


def read_graph(spark: SparkSession, path: str) -> GraphView:
    """The first graph of a file, checked."""
    rows = _checked(spark, path)
    w = F.col("w")
    vtx = rows.where(w[0] == "v").select(w[1].cast("long").alias("vid"), w[2].alias("label"))
    half = rows.where(w[0] == "e").select(w[1].cast("long").alias("a"), w[2].cast("long").alias("b"))
    return GraphView.of(vtx, half).check()


def read_query(spark: SparkSession, path: str) -> QueryGraph:
    """A query graph: as ``read_graph``, gathered on the driver; vertices are numbered in the order of their ids."""
    g = read_graph(spark, path)
    labels = {r.vid: r.label for r in g.vtx.collect()}
    at = {v: i for i, v in enumerate(sorted(labels))}
    return QueryGraph.of([labels[v] for v in sorted(labels)], [(at[r.src], at[r.dst]) for r in g.edge.collect()])


def write_graph(view: GraphView, path: str, graph_id: str = "0") -> None:
    """Write a view in the same format, as one file (edges once, in order)."""
    line = lambda rank, a, b, *cells: (F.lit(rank).alias("r"), a.alias("a"), b.alias("b"), F.concat_ws(" ", *cells).alias("value"))
    zero = F.lit(0).cast("long")
    head = view.vtx.sparkSession.range(1).select(*line(0, zero, zero, F.lit("t"), F.lit("#"), F.lit(graph_id)))
    vertices = view.vtx.select(*line(1, F.col("vid"), zero, F.lit("v"), F.col("vid"), F.col("label")))
    edges = view.edge.where("src < dst").select(*line(2, F.col("src"), F.col("dst"), F.lit("e"), F.col("src"), F.col("dst")))
    head.unionByName(vertices).unionByName(edges).orderBy("r", "a", "b").coalesce(1).select("value").write.mode("overwrite").text(path)
