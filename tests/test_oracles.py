"""Every registered query gives the rows of its SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from dealloom.plans import registry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    out = registry.queries()[name](spark, SF)
    got = sorted(map(str, plain(out.columns, [tuple(r) for r in out.collect()])))
    if name in registry.oracle_sql():
        cursor = duck.execute(registry.oracle_sql()[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(out.columns)
        assert sorted(map(str, plain(columns, cursor.fetchall()))) == got


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: None if v is None else float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)
    return [tuple(one(r[i]) for i in order) for r in rows]
