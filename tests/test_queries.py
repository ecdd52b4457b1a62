"""Every core query against its SQL over the smallest tables."""

import decimal
import math
import os
from pathlib import Path

import pytest

from telar.plans.catalogue import MODULES, ORACLE, QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def text(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if hasattr(v, "isoformat"):
        return (v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_the_catalogue_is_whole():
    assert sum(len(m.QUERIES) for m in MODULES) == len(QUERIES)
    assert set(ORACLE) <= set(QUERIES)
    assert all(q.__doc__ for q in QUERIES.values())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    got = sorted(tuple(text(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        places = [columns.index(c) for c in sorted(columns)]
        assert got == sorted(tuple(text(r[i]) for i in places) for r in found.fetchall())
