"""Every query against its SQL, on the smallest tables."""

import pytest

from shardlore.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, same, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in SQL:
        assert same(got, duck.execute(SQL[name]).fetchdf())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry_without_the_optional_part(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("shardlore.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "shardlore.llm", None)
    try:
        importlib.reload(entry)
        assert set(entry.queries()) == set(QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
