"""Every registered query with SQL against DuckDB, and the others for their rows, over the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from millrace.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    return x.replace(tzinfo=None).isoformat() if isinstance(x, datetime.datetime) else x


def test_names_of_sql():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, str(DATA))
    rows = [r.asDict() for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name not in SQL:
        assert rows
        return
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    r = c.sql(SQL[name])
    columns = sorted(r.columns)
    assert columns == sorted(df.columns)
    want = [dict(zip(r.columns, x)) for x in r.fetchall()]
    key = lambda table: sorted(repr([plain(x[k]) for k in columns]) for x in table)
    assert key(rows) == key(want)
