"""Registered queries against their SQL in another engine, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from voxtable import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in rel.fetchall())
    assert sorted(str([plain(r[c]) for c in cols]) for r in df.collect()) == want
