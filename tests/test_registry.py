import pytest

import __spark_entry__ as entry
from compare import check, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    ok, message = check(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name])
    assert ok, message


def test_optional_subjects_may_be_absent(monkeypatch):
    import sys
    for name in entry.OPTIONAL:
        monkeypatch.setitem(sys.modules, name, None)  # as if the module were not there
    names = entry.queries()
    assert "annual_series" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
    assert set(entry.oracle_sql()) <= set(names)
