"""Every registered numeric query against its SQL at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from tallyforge.plans import catalog

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.sql(catalog.ORACLE_SQL[name])
    assert cols == sorted(found.columns)
    kinds = dict(zip(found.columns, map(str, found.types), strict=True))
    assert all(KINDS[k] == kinds[c] for c, k in df.dtypes)
    assert plain(df.select(*cols).collect()) == plain(found.select(*cols).fetchall())
