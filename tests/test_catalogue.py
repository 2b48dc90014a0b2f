"""Every query of the core runs on the smallest tables, and equals its SQL."""

import glob
import math
import os

import duckdb
import pytest

from talliflow.plans import catalogue


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        return "nan" if math.isnan(v) else round(float(v), 6)
    except TypeError:
        return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, name):
    df = catalogue.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in catalogue.SQL:
        return
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    cur = con.execute(catalogue.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in cur.fetchall())


def test_entry_point(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).collect()) == 1
