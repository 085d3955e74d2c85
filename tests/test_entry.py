"""The driver entry works with and without the optional corpus operators."""

import importlib
import sys

import pytest

import __spark_entry__
from outage_spark.plans.catalog import QUERIES


@pytest.mark.parametrize("absent", ["outage_spark.llm", "corpus_pipeline"])
def test_entry_without_corpus_operators(monkeypatch, absent):
    for name in [m for m in sys.modules if m.startswith(("outage_spark.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, absent, None)
    entry = importlib.reload(__spark_entry__)
    try:
        assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) <= set(QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
