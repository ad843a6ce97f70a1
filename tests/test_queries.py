"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessella.plans.registry import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    cells = {c: [("null" if v is None or v is pd.NA or v != v else f"{float(v):.6f}" if isinstance(v, float) else str(v)) for v in df[c].tolist()] for c in df.columns}
    floats = [c for c in df.columns if any("." in x and x.replace(".", "").replace("-", "").isdigit() for x in cells[c])]
    rows = zip(*[[f"{float(x):.6f}" if c in floats and x != "null" else x for x in cells[c]] for c in df.columns])
    return sorted(tuple("0.000000" if x == "-0.000000" else x for x in r) for r in rows)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query(spark, duck, name):
    query, sql = QUERIES[name]
    ours, theirs = query(spark, SF).toPandas(), duck.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs) > 0
    a, b = canonical(ours), canonical(theirs)
    differ = [(x, y) for x, y in zip(a, b) if any(p != q and not close(p, q) for p, q in zip(x, y))]
    assert not differ, differ[:3]


def close(p, q):
    try:
        return abs(float(p) - float(q)) <= 2e-6 * max(1.0, abs(float(q)))
    except ValueError:
        return False


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_query_without_sql(spark, name):
    assert QUERIES[name][0](spark, SF).count() > 0


def test_session_windows_at_their_edges(spark, tmp_path):
    """Pauses of just the gap, a millisecond less and more, none, and events without a time or a user."""
    gap = 10_800_000
    log = [(1, 0), (1, gap), (1, 2 * gap - 1), (1, 3 * gap), (1, 3 * gap), (2, 5), (2, None), (3, None), (3, None), (None, 7), (None, 7 + gap), (None, None)]
    at = lambda ms: None if ms is None else (pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=ms)).to_pydatetime()
    rows = [(i, u, at(ms), "view", '{"k": 1}', 1.0) for i, (u, ms) in enumerate(log)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, props string, value double").write.parquet(f"{tmp_path}/events.parquet")
    query, sql = QUERIES["session_windows"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    order = lambda found: sorted(found, key=str)
    ours = [tuple(r[c] for c in ("user_id", "first_at", "last_at", "n")) for r in query(spark, str(tmp_path)).collect()]
    assert order(ours) == order(con.execute(sql).fetchall())
    assert len(ours) == 9
