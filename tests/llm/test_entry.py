"""The queries of this subpackage that SQL can express, against it on the smallest tables; all of them run."""

import os

import pytest

from lodestone.llm import entry

from ..test_catalog import SF, cell, duck  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):  # noqa: F811
    got, want = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(cell(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries()) == list(range(1, 14))
