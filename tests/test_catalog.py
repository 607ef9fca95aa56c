"""Every registered query of the document pipeline against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from docpipe.plans import catalog
from docpipe.plans.derived import TABLES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return tuple(map(plain, x))
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (float, np.floating)):
        return int(x) if float(x).is_integer() else round(float(x), 9)
    return int(x) if isinstance(x, np.integer) else x if isinstance(x, int) else str(x)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(map(plain, r)) for r in frame[cols].itertuples(index=False)), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    assert rows(catalog.QUERIES[name](spark, D).toPandas()) == rows(con.execute(catalog.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
