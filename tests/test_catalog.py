"""Every registered query of the retrieval side against its SQL on the smallest tables."""

import math
import os

import pytest

from lodestone.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF}/{name}'")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if hasattr(v, "tzinfo"):
        v = v.replace(tzinfo=None)
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_rows_as_sql(spark, duck, name):
    f, sql = QUERIES[name]
    got = f(spark, SF)
    want = duck.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_runs(spark, name):
    assert QUERIES[name][0](spark, SF).count() > 0


def test_what_is_made_once_is_made_anew_where_it_is_gone(spark, tmp_path):
    import shutil

    from lodestone.plans.catalog import once
    from lodestone.sources.tables import WRITTEN, written

    spark.range(3).write.parquet(str(tmp_path / "documents.parquet"))
    made = []
    make = lambda: made.append(1) or written(spark.range(len(made)), "x")
    assert once(spark, str(tmp_path), "x", make) is once(spark, str(tmp_path), "x", make) and len(made) == 1
    shutil.rmtree(WRITTEN[-1])
    assert once(spark, str(tmp_path), "x", make).count() == 2 and len(made) == 2
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert once(spark, str(tmp_path), "x", make).count() == 3
