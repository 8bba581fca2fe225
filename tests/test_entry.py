"""Every query runs on the smallest data, and equals its SQL where it has some."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.fixture(scope="session")
def duck():
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=lambda t: [(v is None, str(v)) for v in t])
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [x[0] for x in result.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall()), key=lambda t: [(v is None, str(v)) for v in t])
        assert [list(map(str, t)) for t in got] == [list(map(str, t)) for t in want]
