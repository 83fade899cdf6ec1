"""Each registered query against its SQL on the small tables."""

import pytest

from larkspool.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, small, name):
    got = catalog.QUERIES[name](spark, small).toPandas()
    want = duck.sql(catalog.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()), key=repr) for df in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert {"overlap_stitch", "window_plan"} <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
