"""Every query with SQL gives what the SQL gives, on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
BASE = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(BASE).exists(), reason="no test tables")

from kumihimo.plans import registry  # noqa: E402

registry.load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(BASE).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str):
        return v
    return round(float(v), 4) if isinstance(v, int | float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, BASE)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = con.execute(registry.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert mine == theirs
