"""Every query of the library's own operators against its SQL in DuckDB."""

import pytest
from helpers import DATA

from quillwork.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, DATA).count() > 0
