"""Every query with SQL against DuckDB on the smallest tables; the driver's entry points."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if getattr(v, "tzinfo", None) is not None:
        return str(v.replace(tzinfo=None))
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(ROOT).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, ROOT)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    if name in SQL:
        rel = duck.execute(SQL[name])
        at = [c[0] for c in rel.description]
        assert sorted(at) == cols
        assert mine == sorted((tuple(norm(r[at.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)
