"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry

SF_DIR = f"{oracle.TESTDATA}/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert oracle.type_differences(df, duck, SQL[name]) == []
    columns, rows = oracle.spark_rows(df)
    expected_columns, expected = oracle.duck_rows(duck, SQL[name])
    assert columns == expected_columns
    assert rows == expected
    assert rows


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 2 and {row["metric"] for row in rows} == {"areaUnderROC"}
