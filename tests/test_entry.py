"""The driver's contract."""

import importlib
import sys


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_llm(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "_has_llm", lambda: False)
    assert not [n for n in e.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
    importlib.reload(sys.modules["__spark_entry__"])
