import importlib
import sys

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_sql_names_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_without_training_data(monkeypatch):
    import graphloom

    monkeypatch.setitem(sys.modules, "graphloom.llm", None)
    for name in [n for n in sys.modules if n.startswith("graphloom.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(graphloom, "llm", raising=False)
    fresh = importlib.reload(entry)
    assert "match_triangle_t1" in fresh.queries() and "op1_url_filter" not in fresh.queries()
