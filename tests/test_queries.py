"""Every alignment query against its SQL."""

import pytest

from strandtally.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
