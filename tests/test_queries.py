"""Every query with SQL gives DuckDB's rows over the whole smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as engine
from tidemill import registry

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) is not None else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = engine.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    r = duck.execute(engine.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x[c]) for c in columns) for x in df.collect()), key=repr) == theirs


def test_entry(spark):
    rows = engine.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"host", "pages"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, name):
    assert engine.queries()[name](spark, str(DATA)).count() > 0
