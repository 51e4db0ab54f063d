"""Each query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidegraph.plans import catalogue
from verify import TABLES, normal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    rows = got.toPandas()
    assert list(rows.columns)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        expect = duck.sql(sql)
        x, y = normal(rows), normal(pd.DataFrame(expect.fetchall(), columns=expect.columns))
        assert list(x.columns) == list(y.columns) and x.to_dict("list") == y.to_dict("list")
