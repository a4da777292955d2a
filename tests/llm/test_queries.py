"""The queries of the subpackage: their SQL, and tables without rows or values."""

import re

import pytest

from lakemason.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(same_as_sql, name):
    same_as_sql(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if re.match(r"p\d+_", n)))
def test_dealt_queries_on_bare_tables(spark, bare, name, kind):
    rows = QUERIES[name](spark, f"{bare}/{kind}").collect()
    kept = {"p8_ids", "p6_redacted"} if kind == "nulls" else set()
    assert bool(rows) == (name in kept)
    if name == "p8_ids":
        assert all(list(r["ids"]) == [] for r in rows)
