"""The queries that have SQL, against DuckDB on the smallest tables."""

import pytest

from tessella.llm.registry import QUERIES
from tests.test_queries import SF, canonical, close, duck  # noqa: F401


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query(spark, duck, name):  # noqa: F811
    query, sql = QUERIES[name]
    ours, theirs = query(spark, SF).toPandas(), duck.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs) > 0
    a, b = canonical(ours), canonical(theirs)
    assert not [(x, y) for x, y in zip(a, b) if any(p != q and not close(p, q) for p, q in zip(x, y))]
