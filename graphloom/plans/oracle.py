"""DuckDB SQL for the same questions, by the lattice identity."""
from __future__ import annotations

from ..sources.views import SQL_VIEWS
from .query import Edge, QueryGraph


def _present(a: int, b: int) -> str:
    return f"EXISTS (SELECT 1 FROM edge e WHERE e.src = m{a} AND e.dst = m{b})"


def embed(q: QueryGraph, edges: tuple[Edge, ...]) -> str:
    """All embeddings of a connected spanning pattern: a chain of joins of the typed edges."""
    if not edges:
        return f"SELECT vid AS m0 FROM vtx WHERE label = '{q.labels[0]}'"
    at, left, joins = {edges[0][0]: "e0.src", edges[0][1]: "e0.dst"}, list(edges[1:]), []
    cond = [f"e0.sl = '{q.labels[edges[0][0]]}' AND e0.dl = '{q.labels[edges[0][1]]}'"]
    while left:
        u, w = min((e for e in left if e[0] in at or e[1] in at), key=lambda e: not (e[0] in at and e[1] in at))
        left.remove((u, w))
        if u not in at:
            u, w = w, u
        t = f"e{len(joins) + 1}"
        on = [f"{t}.src = {at[u]}", f"{t}.sl = '{q.labels[u]}'", f"{t}.dl = '{q.labels[w]}'"]
        if w in at:
            on.append(f"{t}.dst = {at[w]}")
        else:
            on += [f"{t}.dst <> {at[x]}" for x in at if q.labels[x] == q.labels[w]]
            at[w] = f"{t}.dst"
        joins.append(f"JOIN te {t} ON {' AND '.join(on)}")
    return f"SELECT {', '.join(f'{at[u]} AS m{u}' for u in range(q.size))} FROM te e0 {' '.join(joins)} WHERE {' AND '.join(cond)}"


def match_sql(q: QueryGraph, threshold: int, view: str = "returned_together", select: str | None = None) -> str:
    """All mappings with their missing edges, or ``select`` from them as ``r``."""
    found = "\nUNION\n".join(embed(q, p) for p in q.terminals(threshold))
    missing = " + ".join(f"CASE WHEN p{i}.src IS NULL THEN 1 ELSE 0 END" for i in range(len(q.edges)))
    joins = " ".join(f"LEFT JOIN edge p{i} ON p{i}.src = m{a} AND p{i}.dst = m{b}" for i, (a, b) in enumerate(q.edges))
    typed = "te AS (SELECT src, dst, a.label AS sl, b.label AS dl FROM edge JOIN vtx a ON a.vid = src JOIN vtx b ON b.vid = dst)"
    body = f"{typed}, f AS ({found}), r AS (SELECT {', '.join(f'm{u}' for u in range(q.size))}, CAST({missing or 0} AS INTEGER) AS missing FROM f {joins})"
    return f"WITH {SQL_VIEWS[view]}, {body} {select or 'SELECT * FROM r'}"


def graph_sql(select: str, view: str = "returned_together") -> str:
    return f"WITH {SQL_VIEWS[view]} {select}"
