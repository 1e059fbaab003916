import time

import pytest

from graphloom.cli import main
from graphloom.deadline import within
from graphloom.plans.config import MatchConfig
from graphloom.plans.query import pattern
from graphloom.report import run_match
from graphloom.sources.graph_text import read_graph, read_query, write_graph
from tests.graphs import EDGES, LABELS, TOY, view

QUERY = "t # 1\nv 0 A\nv 1 B\nv 2 C\ne 0 1\ne 1 2\ne 0 2\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "g.txt").write_text(TOY)
    (tmp_path / "q.txt").write_text(QUERY)
    return tmp_path


def test_reads_first_graph(spark, files):
    g = read_graph(spark, str(files / "g.txt"))
    assert {r.vid: r.label for r in g.vtx.collect()} == LABELS
    assert {(r.src, r.dst) for r in g.edge.collect() if r.src < r.dst} == EDGES
    assert read_query(spark, str(files / "q.txt")) == pattern("triangle", "ABC")


@pytest.mark.parametrize("text", ["v 0 A\n", "t # 0\nx 1 2\n", "t # 0\nv zero A\n", "t # 0\nv 0 A\ne 0 1\n", "t # 0\nv 0 A\nv 0 B\n", "t 0\n"])
def test_bad_files(spark, tmp_path, text):
    (tmp_path / "g.txt").write_text(text)
    with pytest.raises(ValueError):
        read_graph(spark, str(tmp_path / "g.txt"))


def test_round_trip(spark, tmp_path):
    write_graph(view(spark, LABELS, EDGES), str(tmp_path / "out"))
    g = read_graph(spark, str(next((tmp_path / "out").glob("part-*"))))
    assert {r.vid: r.label for r in g.vtx.collect()} == LABELS and g.edge.count() == 2 * len(EDGES)


def test_cli(spark, files, capsys):
    args = ["-d", str(files / "g.txt"), "-q", str(files / "q.txt")]
    assert main([*args, "-t", "1", "-a", "decq", "-o", str(files / "out")], spark) == 0
    out = capsys.readouterr().out
    assert "count=6" in out and "filter_candidates=NA" in out and "effective_threshold=1" in out
    assert spark.read.parquet(str(files / "out")).count() == 6
    assert main([*args, "-t", "-1"], spark) == 1
    with pytest.raises(SystemExit):
        main(args, spark)


def test_report(spark):
    r = run_match(view(spark, LABELS, EDGES), pattern("triangle", "ABC"), 5, MatchConfig(candidates=True, limit=4))
    assert (r.count, r.effective_threshold, r.output_limit_reached) == (4, 1, 1) and r.filter_candidates > 0
    assert r.table(spark).first()["count"] == 4


def test_deadline(spark):
    assert within(spark, 60, "quick", lambda: 1) == 1
    with pytest.raises(TimeoutError):
        within(spark, 1.5, "slow", lambda: spark.range(8, numPartitions=8).rdd.map(lambda x: time.sleep(30)).count())
