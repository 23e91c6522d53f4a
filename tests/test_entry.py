import importlib
import sys

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["class_ord", "full_name"] and df.count() > 0


def test_every_query_of_the_core_has_sql():
    from quern.plans import bindings

    assert set(bindings.QUERIES) == set(bindings.SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("quern.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("quern.llm", "quern.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    alone = importlib.reload(entry)
    try:
        assert "class_search_or" in alone.queries() and not any(k.startswith("op") or k == "pipeline" for k in alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
