import importlib
import sys

import __spark_entry__ as entry


def test_registry_names_match():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 40


def test_entry_without_the_document_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("steadyframes.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "steadyframes.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    e = importlib.reload(entry)
    assert not any(n.startswith("op") or n == "pipeline" for n in e.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_searches_run_the_whole_grids(spark, monkeypatch):
    from steadyframes.jobs import catalog, search

    grids = []

    def seen(frames, grid, *_, crop):
        grids.append(grid.count())
        return spark.createDataFrame([], "combo_id long, video_id long, frames long, ratio double")

    monkeypatch.setattr(search, "search_align", seen)
    monkeypatch.setattr(search, "search_smoother", seen)
    for name in ("c7_search_align", "c8_search_smoother"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert grids == [54, 3888]
