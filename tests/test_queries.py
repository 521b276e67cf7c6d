"""Every core query against its SQL, on the small tables."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from driftline import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def sorted_rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(None if x != x else float(x) if isinstance(x, (int, float, np.number)) else str(x) for x in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sql, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), sql.execute(queries.ORACLES[name]).df()
    a, b = sorted_rows(got), sorted_rows(want)
    assert a[0] == b[0] and len(a[1]) == len(b[1])
    numbers = [k for k, x in enumerate(a[1][0]) if isinstance(x, float)] if a[1] else []
    for k in range(len(a[0])):
        x, y = [r[k] for r in a[1]], [r[k] for r in b[1]]
        assert np.allclose(x, y, atol=2e-3, rtol=1e-9) if k in numbers else x == y


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
