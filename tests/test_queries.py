"""Every facility query against its SQL at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from restgrid.operators import search
from restgrid.plans import registry
from restgrid.plans.fixtures import view

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def rows(df):
    plain = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, oracle, name):
    got = registry.QUERIES[name](spark, small).toPandas()
    if name in registry.SQL:
        want = oracle.execute(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sql_is_text():
    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())


def test_arguments_are_checked(spark, small):
    f = view(spark, small, "facilities")
    for bad in ((999, 0, 1000, 1), (0, 999, 1000, 1), (0, -999, 1000, 1), (0, 0, -1, 1), (0, 0, 1000, 0)):
        with pytest.raises(ValueError):
            search.nearest(f, *bad)
    assert search.nearest(f, 0, -40, 1000, 1).count() == 0


def test_box_reaches_the_scan_of_a_stored_table(spark, small, tmp_path):
    view(spark, small, "facilities").write.parquet(str(tmp_path / "f"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = search.viewport(spark.read.parquet(str(tmp_path / "f")), 51, 53, -2, 1)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(latitude" in plan.split("PushedFilters")[-1]


def test_grid_join_is_no_nested_loop(spark, small):
    found = search.nearest_per_probe(view(spark, small, "facilities"), view(spark, small, "probes"), "town", 25.0)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
