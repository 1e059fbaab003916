"""Small graphs for the tests."""
from graphloom.operators.graph import GraphView

TOY = """junk before the header
t # 0
v 0 A
v 1 B
v 2 C
v 3 A
v 4 B

v 5 C
v 6 D
e 0 1
e 1 2 x
e 0 2
e 0 4
e 3 4
e 4 5
e 2 3
e 5 6
e 2 6
e 6 2
e 3 3
t # 1
v 0 Z
"""

LABELS = dict(enumerate("ABCABCD"))
EDGES = {(0, 1), (1, 2), (0, 2), (0, 4), (3, 4), (4, 5), (2, 3), (5, 6), (2, 6)}


def view(spark, labels, edges):
    vtx = spark.createDataFrame([(v, x) for v, x in labels.items()], "vid long, label string")
    return GraphView.of(vtx, spark.createDataFrame([tuple(e) for e in edges], "a long, b long"))


def rows(df):
    """Mappings and their missing edges, with repeats."""
    k = len(df.columns) - 1
    return sorted((tuple(r[f"m{u}"] for u in range(k)), r["missing"]) for r in df.collect())
