"""Each query with SQL gives DuckDB's rows; each without gives rows."""

import os

import duckdb
import pytest

from quarry.queries import QUERY_FUNCTIONS, SQL


def plain(x):
    return repr(round(x, 5)) if isinstance(x, float) else [plain(y) for y in x] if isinstance(x, list) else repr(x)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows(name, spark, sf_dir, duck):
    df = QUERY_FUNCTIONS[name](spark, sf_dir)
    got = df.collect()
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [df.columns.index(n) for n in names]
    assert sorted(str([plain(r[i]) for i in at]) for r in got) == sorted(str([plain(v) for v in r]) for r in found.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERY_FUNCTIONS if n not in SQL])
def test_has_rows(name, spark, sf_dir):
    assert QUERY_FUNCTIONS[name](spark, sf_dir).count() > 0
