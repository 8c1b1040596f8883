"""Each query against its SQL in DuckDB on the smallest tables, and the others for their rows."""

import math

import pytest
from conftest import SF

from pulselake import plans


def cell(v):
    return ("nan" if math.isnan(v) else v + 0.0) if isinstance(v, float) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, tables, name):
    got = plans.QUERIES[name](spark, SF)
    want = tables.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["breakdown", "name", "windows", "valid", "mae", "rmse", "bias"]
    assert set(plans.SQL) <= set(entry.oracle_sql()) and set(plans.QUERIES) <= set(entry.queries())
