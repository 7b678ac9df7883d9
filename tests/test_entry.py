import importlib
import re
import sys


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_removable_part(monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("obsengine.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "obsengine.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(entry)
    assert "matched_controls" in bare.queries() and not any(re.match(r"op\d+_|pipeline", q) for q in bare.queries())
    monkeypatch.undo()
    importlib.reload(entry)
