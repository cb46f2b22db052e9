"""Every registered query outside the training-data subpackage against its SQL."""

import duckdb
import pandas as pd
import pytest

from tidewell import analyzer_queries, plan_queries, report_queries, rollup_queries
from tools_compare import TABLES, tidy

SF = "/root/testdata/sf0.001"
MODULES = (analyzer_queries, plan_queries, rollup_queries, report_queries)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    rel = duck.execute(SQL[name])
    columns = [c[0] for c in rel.description]
    assert sorted(got.columns) == sorted(columns)
    assert tidy(got) == tidy(pd.DataFrame(rel.fetchall(), columns=columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
