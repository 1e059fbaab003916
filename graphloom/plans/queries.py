"""The registered graph queries, each with its SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mappings
from ..operators import candidates, stats
from ..operators.graph import GraphView
from ..sources.views import shared_view
from . import index, lattice
from .config import VARIANTS, MatchConfig
from .match import match, match_counts
from .oracle import _present, graph_sql, match_sql
from .query import PATTERNS, QueryGraph, pattern

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def brands(*numbers: int) -> list[str]:
    return [f"Brand#{i}" for i in numbers]


TRIANGLE = pattern("triangle", brands(1, 1, 2))
DIAMOND = pattern("diamond", brands(1, 2, 3, 4))
TAILED = pattern("tailed_triangle", brands(1, 2, 3, 4))
TRADE = pattern("triangle", ["cust:BUILDING", "supplier", "nation"])
TRADE_TAIL = pattern("tailed_triangle", ["cust:BUILDING", "supplier", "nation", "region"])


def _add(name: str, make: Callable[[GraphView], DataFrame], sql: str, view: str = "returned_together") -> None:
    QUERIES[name] = lambda spark, sf_dir: make(shared_view(spark, sf_dir, view))
    ORACLE_SQL[name] = sql if sql.startswith("WITH") else graph_sql(sql, view)


def _match(name: str, q: QueryGraph, t: int, config: MatchConfig = MatchConfig(), view: str = "returned_together") -> None:
    _add(name, lambda g: match(g, q, t, config), match_sql(q, t, view), view)


# matches by pattern and threshold, by strategy and by variant
for _name, (_k, _edges) in PATTERNS.items():
    _q = pattern(_name, brands(*range(1, _k + 1)))
    for _t in range(min(2, _q.cycle_rank) + 1):
        _match(f"match_{_name}_t{_t}", _q, _t)
for _s in ("branch", "tree", "lattice", "fragment", "index", "bruteforce"):
    _match(f"match_triangle_repeated_{_s}", TRIANGLE, 1, MatchConfig(strategy=_s))
for _s in ("branch", "tree", "lattice", "fragment"):
    _match(f"match_diamond_t2_{_s}", DIAMOND, 2, MatchConfig(strategy=_s))
    _match(f"match_trade_tail_{_s}", TRADE_TAIL, 1, MatchConfig(strategy=_s), "trade")
for _key, _config in VARIANTS.items():
    _match(f"variant_{_key}", TRIANGLE, 1, _config)
_match("match_trade_triangle", TRADE, 1, view="trade")
_match("match_filtered", TAILED, 1, MatchConfig(candidates=True, bridge_filter=True, spoke_filter=True))
_match("match_exact_diamond", DIAMOND, 0)
_match("match_single_vertex", QueryGraph.of(brands(1), []), 0)
_match("match_unknown_label", pattern("triangle", ["Brand#1", "no such brand", "Brand#2"]), 1)

# counts, limits, checks
_add("match_count_by_missing", lambda g: match_counts(g, DIAMOND, 2), match_sql(DIAMOND, 2, select="SELECT missing, count(*) AS matches FROM r GROUP BY missing"))
_add("match_count_deferred", lambda g: match_counts(g, DIAMOND, 2, MatchConfig(defer="always", cost_split=True)), ORACLE_SQL["match_count_by_missing"])
_add("match_count", lambda g: match(g, DIAMOND, 2).agg(F.count(F.lit(1)).alias("matches")), match_sql(DIAMOND, 2, select="SELECT count(*) AS matches FROM r"))
_add("match_limit", lambda g: match(g, TRADE, 1, MatchConfig(limit=100)).agg(F.count(F.lit(1)).alias("matches")), match_sql(TRADE, 1, "trade", "SELECT least(count(*), 100) AS matches FROM r"), "trade")
_add("validate_mappings", lambda g: mappings.violations(match(g, DIAMOND, 2), g, DIAMOND, 2), "SELECT 0::BIGINT AS not_total, 0::BIGINT AS wrong_label, 0::BIGINT AS not_injective, 0::BIGINT AS over_budget, 0::BIGINT AS disconnected, 0::BIGINT AS wrong_missing, 0::BIGINT AS repeated")
_mask = " + ".join(f"CASE WHEN {_present(a, b)} THEN {1 << i} ELSE 0 END" for i, (a, b) in enumerate(DIAMOND.edges))
_add("canonical_pattern_rows", lambda g: lattice.canonical_counts(g, DIAMOND, 2, match(g, DIAMOND, 2)), match_sql(DIAMOND, 2, select=f"SELECT CAST({_mask} AS BIGINT) AS mask, missing, count(*) AS matches FROM r GROUP BY ALL"))
_add("match_distinct_vertices", lambda g: match(g, TAILED, 1).select(F.explode(F.array("m0", "m1", "m2", "m3")).alias("vid")).distinct(), match_sql(TAILED, 1, select="SELECT m0 AS vid FROM r UNION SELECT m1 FROM r UNION SELECT m2 FROM r UNION SELECT m3 FROM r"))
_add("match_top_missing", lambda g: match(g, DIAMOND, 2).orderBy(F.desc("missing"), "m0", "m1", "m2", "m3").limit(20), match_sql(DIAMOND, 2, select="SELECT * FROM r ORDER BY missing DESC, m0, m1, m2, m3 LIMIT 20"))

# joins
_triangle = pattern("triangle", brands(1, 2, 3))
_matcher = lambda g, q: (lambda s: lattice.Matcher(g, q, s.size_of, s.selectivity))(stats.PlanStatistics(g, q))
_path = "SELECT a.vid AS m0, b.vid AS m1, c.vid AS m2 FROM vtx a JOIN edge e ON e.src = a.vid JOIN vtx b ON b.vid = e.dst JOIN edge f ON f.src = b.vid JOIN vtx c ON c.vid = f.dst WHERE a.label = 'Brand#1' AND b.label = 'Brand#2' AND c.label = 'Brand#3'"
_add("join_exact_pattern", lambda g: _matcher(g, _triangle).exact(_triangle.edges), f"{_path} AND EXISTS (SELECT 1 FROM edge x WHERE x.src = a.vid AND x.dst = c.vid)")
_add("join_leaf_extension", lambda g: (lambda x: x.leaf(x.edge_rows((0, 1)), [0, 1], (1, 2)).select("m0", "m1", "m2"))(_matcher(g, _triangle)), _path)
_add("join_fragment_hash", lambda g: (lambda x: x.join_fragments([(frozenset(e), x.edge_rows(e), 1.0) for e in ((0, 1), (1, 2))]).select("m0", "m1", "m2"))(_matcher(g, _triangle)), _path)
_add("filter_restored_edge", lambda g: (lambda x: x.restore(x.exact(((0, 1), (1, 2))), (0, 2)))(_matcher(g, _triangle)), ORACLE_SQL["join_exact_pattern"])
_add("filter_missing_edge", lambda g: lattice.canonical(_matcher(g, _triangle).exact(((0, 1), (1, 2))), g, _triangle, ((0, 1), (1, 2))), f"{_path} AND NOT EXISTS (SELECT 1 FROM edge x WHERE x.src = a.vid AND x.dst = c.vid)")
_add("edge_canonical", lambda g: g.edge, "SELECT src, dst FROM edge")
_add("edge_probe", lambda g: g.has_edge(g.with_label("Brand#1", "a").join(g.with_label("Brand#2", "b"))), "SELECT a.vid AS a, b.vid AS b, EXISTS (SELECT 1 FROM edge WHERE src = a.vid AND dst = b.vid) AS present FROM vtx a, vtx b WHERE a.label = 'Brand#1' AND b.label = 'Brand#2'")
_add("vertex_neighbours", lambda g: g.neighbours(g.with_label("Brand#1", "vid")), "SELECT vid, dst AS nbr FROM vtx JOIN edge ON src = vid WHERE label = 'Brand#1'")
_add("adjacency_lists", lambda g: g.adjacency().select("vid", F.concat_ws(",", "nbrs").alias("nbrs")), "SELECT src AS vid, string_agg(dst, ',' ORDER BY dst) AS nbrs FROM edge GROUP BY src")
_add("graph_describe", lambda g: g.describe(), "SELECT (SELECT count(*) FROM vtx) AS vertices, (SELECT count(*) FROM edge) AS directed_edges, (SELECT max(n) FROM (SELECT count(*) AS n FROM edge GROUP BY src)) AS max_degree, (SELECT count(DISTINCT label) FROM vtx) AS labels")
_add("label_codes", lambda g: g.label_codes(), "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT label FROM vtx)")

# statistics
_add("stat_degree", stats.degrees, "SELECT vid, count(src) AS degree FROM vtx LEFT JOIN edge ON src = vid GROUP BY vid")
_add("stat_label_freq", stats.label_frequency, "SELECT label, count(*) AS vertices FROM vtx GROUP BY label")
_pairs = "SELECT a.label AS label_a, b.label AS label_b, count(*) AS edges FROM edge JOIN vtx a ON a.vid = src JOIN vtx b ON b.vid = dst GROUP BY ALL"
_add("stat_edge_label_freq", stats.edge_label_frequency, _pairs)
_add("stat_nlf", stats.neighbour_labels, "SELECT src AS vid, label, count(*) AS n FROM edge JOIN vtx ON vid = dst GROUP BY ALL")
_sel = f"SELECT label_a, label_b, edges / (CASE WHEN label_a = label_b THEN x.n * (y.n - 1) ELSE x.n * y.n END) AS selectivity FROM ({_pairs}) p JOIN (SELECT label, count(*) AS n FROM vtx GROUP BY label) x ON x.label = label_a JOIN (SELECT label, count(*) AS n FROM vtx GROUP BY label) y ON y.label = label_b"
_add("stat_selectivity", lambda g: stats.selectivity(g).withColumn("selectivity", F.round("selectivity", 9)), f"SELECT label_a, label_b, round(selectivity, 9) AS selectivity FROM ({_sel})")
_add("stat_selectivity_range", lambda g: stats.selectivity_range(g, DIAMOND).select(*[F.round(c, 9).alias(c) for c in ("least", "mean", "largest")]), f"SELECT round(min(coalesce(selectivity, 0)), 9) AS least, round(avg(coalesce(selectivity, 0)), 9) AS mean, round(max(coalesce(selectivity, 0)), 9) AS largest FROM (VALUES {', '.join(f"('{DIAMOND.labels[a]}', '{DIAMOND.labels[b]}')" for a, b in DIAMOND.edges)}) w(a, b) LEFT JOIN ({_sel}) ON label_a = a AND label_b = b")

# candidates: need(u, label, n), held(u, label, n) for bridges
def _need_sql(q: QueryGraph) -> str:
    held = dict(((u, x), n) for u, x, n in candidates._needs(q, tuple(e for e in q.edges if e in q.bridges())))
    rows = ", ".join(f"({u}, '{x}', {n}, {held.get((u, x), 0)})" for u, x, n in candidates._needs(q, q.edges))
    return f"(VALUES {rows}) w(u, label, need, held)"


def _lack_sql(q: QueryGraph) -> str:
    return f"""SELECT w.u, v.vid, CAST(sum(greatest(0, w.need - coalesce(h.n, 0))) AS BIGINT) AS lack, bool_and(w.held <= coalesce(h.n, 0)) AS ok
FROM {_need_sql(q)} JOIN (VALUES {', '.join(f"({u}, '{x}')" for u, x in enumerate(q.labels))}) ql(u, l) ON ql.u = w.u JOIN vtx v ON v.label = ql.l
LEFT JOIN (SELECT src, label, count(*) AS n FROM edge JOIN vtx ON vid = dst GROUP BY ALL) h ON h.src = v.vid AND h.label = w.label GROUP BY w.u, v.vid"""


def _label_sql(q: QueryGraph) -> str:
    return f"SELECT u, vid FROM (VALUES {', '.join(f"({u}, '{x}', {q.degree(u)})" for u, x in enumerate(q.labels))}) w(u, label, d) JOIN vtx USING (label)"


_deg = "(SELECT count(*) FROM edge WHERE src = vid)"
_add("cand_label", lambda g: candidates.by_label(g, DIAMOND), _label_sql(DIAMOND))
_add("cand_degree", lambda g: candidates.by_degree(g, DIAMOND, 1), f"{_label_sql(DIAMOND)} WHERE d <= {_deg} + 1")
_add("cand_exact_degree", lambda g: candidates.by_degree(g, DIAMOND, 0), f"{_label_sql(DIAMOND)} WHERE d <= {_deg}")
for _t in range(3):
    _add(f"cand_nlf_t{_t}", lambda g, t=_t: candidates.by_neighbour_labels(g, DIAMOND, t), f"SELECT u, vid FROM ({_lack_sql(DIAMOND)}) WHERE lack <= {_t}")
_add("cand_exact_nlf", lambda g: candidates.by_neighbour_labels(g, DIAMOND, 0, pattern=DIAMOND.edges), ORACLE_SQL["cand_nlf_t0"])
_add("cand_nlf_bridge", lambda g: candidates.by_neighbour_labels(g, TAILED, 1, bridges=True), f"SELECT u, vid FROM ({_lack_sql(TAILED)}) WHERE lack <= 1 AND ok")
_add("cand_deficit", lambda g: candidates.deficits(g, DIAMOND), f"SELECT u, vid, lack FROM ({_lack_sql(DIAMOND)})")
_add("cand_counts", lambda g: candidates.counts(candidates.by_neighbour_labels(g, DIAMOND, 1)), f"SELECT u, count(*) AS candidates FROM ({_lack_sql(DIAMOND)}) WHERE lack <= 1 GROUP BY u")
_add("cand_bridge_support", lambda g: candidates.by_bridge_support(g, TAILED, candidates.by_label(g, TAILED)), f"WITH_BRIDGE")
_near = "SELECT c.u, c.vid FROM c JOIN edge ON src = c.vid JOIN c o ON o.vid = dst"
ORACLE_SQL["cand_bridge_support"] = graph_sql(f", c AS ({_label_sql(TAILED)}) SELECT u, vid FROM c WHERE u < 2 UNION {_near} WHERE c.u = 2 AND o.u = 3 UNION {_near} WHERE c.u = 3 AND o.u = 2").replace(" , c AS", ", c AS")
_add("stat_pair_support", lambda g: stats.pair_support(g, DIAMOND, candidates.by_label(g, DIAMOND)), f"SELECT c.u AS a, o.u AS b, count(*) AS support FROM ({_label_sql(DIAMOND)}) c JOIN edge ON src = c.vid JOIN ({_label_sql(DIAMOND)}) o ON o.vid = dst WHERE (c.u, o.u) IN ({', '.join(map(str, DIAMOND.edges))}) GROUP BY ALL")
_add("cand_adjacency", lambda g: stats.candidate_edges(g, TRIANGLE, candidates.by_label(g, TRIANGLE)), f"SELECT c.u, c.vid AS v, o.u AS u2, o.vid AS v2 FROM ({_label_sql(TRIANGLE)}) c JOIN edge ON src = c.vid JOIN ({_label_sql(TRIANGLE)}) o ON o.vid = dst WHERE c.u <> o.u")
_add("stat_edge_priority", lambda g: stats.edge_priority(g, DIAMOND, candidates.by_label(g, DIAMOND)).withColumn("priority", F.round("priority", 6)), f"SELECT u, anchor, round(coalesce(c.n * p.edges / c.n, 0), 6) AS priority FROM (VALUES {', '.join(f"({u}, {a}, '{DIAMOND.labels[u]}', '{DIAMOND.labels[a]}')" for e in DIAMOND.edges for u, a in (e, e[::-1]))}) w(u, anchor, la, lb) LEFT JOIN (SELECT label, count(*) AS n FROM vtx GROUP BY label) c ON c.label = la LEFT JOIN ({_pairs}) p ON p.label_a = la AND p.label_b = lb")


def _spoke_sql(q: QueryGraph, t: int) -> str:
    """One round of the spoke rule as a condition per set of query neighbours."""
    from itertools import combinations

    parts = []
    for u in range(q.size):
        nbrs = q.neighbours(u)
        budget = min(q.clamp(t), len(nbrs) - 1)
        conds = []
        for k in range(1, len(nbrs) + 1):
            for c in combinations(nbrs, k):
                least = k - (0 if all(tuple(sorted((u, w))) in q.bridges() for w in c) else budget)
                conds.append(f"(SELECT count(DISTINCT dst) FROM edge JOIN vtx n ON n.vid = dst WHERE src = c.vid AND n.label IN ({', '.join(repr(q.labels[w]) for w in c)})) >= {least}")
        parts.append(f"SELECT {u} AS u, vid FROM vtx c WHERE label = '{q.labels[u]}' AND {' AND '.join(conds)}")
    return " UNION ALL ".join(parts)


def _spoke_once(g: GraphView) -> DataFrame:
    """The spoke filter over bridge and label candidates of a star, whose first round is its fixpoint at the centre."""
    return candidates.by_spokes(g, STAR, 0, candidates.by_label(g, STAR)).where("u = 0")


STAR = QueryGraph.of(brands(1, 2, 3, 4), [(0, 1), (0, 2), (0, 3)])
_add("cand_spoke", _spoke_once, f"SELECT u, vid FROM ({_spoke_sql(STAR, 0)}) WHERE u = 0")

# a fixpoint has no SQL here; the tests hold the filter against plain enumeration
for _t in range(3):
    QUERIES[f"cand_spoke_fixpoint_t{_t}"] = lambda spark, sf_dir, t=_t: (lambda g: candidates.by_spokes(g, DIAMOND, t, candidates.by_label(g, DIAMOND)))(shared_view(spark, sf_dir))

# the synopsis index
_syn = "SELECT v.vid, v.label, coalesce(string_agg(DISTINCT n.label, ',' ORDER BY n.label), '') AS nlabels, count(e.src) AS degree FROM vtx v LEFT JOIN edge e ON e.src = v.vid LEFT JOIN vtx n ON n.vid = e.dst GROUP BY v.vid, v.label"
_add("idx_vertex_synopsis", lambda g: index.vertex_synopsis(g).withColumn("nlabels", F.concat_ws(",", "nlabels")), _syn)
_add("idx_block_synopsis", lambda g: index.roll_up(index.vertex_synopsis(g).withColumn("labels", F.array("label")).withColumn("block", F.col("vid") % 16), "block").select("block", F.concat_ws(",", "labels").alias("labels"), F.concat_ws(",", "nlabels").alias("nlabels"), "degree"), f"SELECT s.vid % 16 AS block, string_agg(DISTINCT s.label, ',' ORDER BY s.label) AS labels, string_agg(DISTINCT n.label, ',' ORDER BY n.label) AS nlabels, max(s.degree) AS degree FROM ({_syn}) s LEFT JOIN edge e ON e.src = s.vid LEFT JOIN vtx n ON n.vid = e.dst GROUP BY s.vid % 16")
_add("idx_majority_label", lambda g: index.majority_label(g.vtx.withColumn("block", F.col("vid") % 16), "block"), "SELECT block, label AS majority FROM (SELECT vid % 16 AS block, label, row_number() OVER (PARTITION BY vid % 16 ORDER BY count(*) DESC, label) AS r FROM vtx GROUP BY vid % 16, label) WHERE r = 1")
_served = lambda q, u: " + ".join(f"(CASE WHEN EXISTS (SELECT 1 FROM edge JOIN vtx n ON n.vid = dst WHERE src = v.vid AND n.label = '{q.labels[w]}') THEN 1 ELSE 0 END)" for w in q.neighbours(u))
_add("idx_candidates", lambda g: index.index_candidates(g, DIAMOND, 1), " UNION ALL ".join(f"SELECT {u} AS u, vid FROM vtx v WHERE label = '{DIAMOND.labels[u]}' AND greatest(0, {DIAMOND.degree(u)} - (SELECT count(*) FROM edge WHERE src = v.vid)) <= 1 AND {DIAMOND.degree(u)} - ({_served(DIAMOND, u)}) <= 1" for u in range(4)))
# the bounds of the index by themselves, for every query vertex
_bounded = lambda g, bound, t: index.vertex_synopsis(g).crossJoin(F.broadcast(g.vtx.sparkSession.range(4).select(F.col("id").cast("int").alias("u")))).where(bound(DIAMOND) <= t).select("u", "vid")  # noqa: E731  (vertices times the query's)
_add("cand_lbnd1", lambda g: _bounded(g, index.degree_bound, 1), " UNION ALL ".join(f"SELECT {u} AS u, vid FROM vtx WHERE greatest(0, {DIAMOND.degree(u)} - (SELECT count(*) FROM edge WHERE src = vid)) <= 1" for u in range(4)))
_add("cand_lbnd2", lambda g: _bounded(g, index.label_bound, 1), " UNION ALL ".join(f"SELECT {u} AS u, vid FROM vtx v WHERE {DIAMOND.degree(u)} - ({_served(DIAMOND, u)}) <= 1" for u in range(4)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of parts returned together, of two brands, with at most one edge missing."""
    return match(shared_view(spark, sf_dir), TRIANGLE, 1)
