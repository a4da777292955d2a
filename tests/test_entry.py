"""Every query with SQL gives the SQL's rows, on the smallest tables where these are at hand."""

import re
import warnings

import pytest

import __spark_entry__ as entry

with warnings.catch_warnings():
    warnings.simplefilter("ignore")  # the subpackage may be absent
    QUERIES = {n: q for n, q in entry.queries().items() if not q.__module__.startswith(entry.LLM)}
    ORACLE = {n: sql for n, sql in entry.oracle_sql().items() if n in QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(same_as_sql, name):
    same_as_sql(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if re.match(r"p\d+_", n)))
def test_dealt_queries_on_bare_tables(spark, bare, name, kind):
    assert not QUERIES[name](spark, f"{bare}/{kind}").collect()


def test_names_and_flagship(spark, data):
    assert set(ORACLE) <= set(QUERIES)
    assert entry.entry(spark).columns == ["coord_id", "landmark_name"]


def test_general_queries_without_the_subpackage(monkeypatch):
    """Whatever the subpackage lacks, the other queries stay."""
    real = entry.importlib.import_module

    def broken(name, *args):
        if name.startswith(entry.LLM):
            raise ImportError("no such library")
        return real(name, *args)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.warns(UserWarning, match="without the queries"):
        assert set(entry.queries()) == set(QUERIES)
