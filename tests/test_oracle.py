"""Every query that has SQL gives what DuckDB gives on the same tables."""

import math
from pathlib import Path

import pytest

from piispan import queries as Q


@pytest.fixture(scope="module")
def con(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, con, sf_dir, name):
    df = Q.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(Q.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(_plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_rows_only(spark, sf_dir, name):
    assert Q.queries()[name](spark, sf_dir).count() > 0
