"""Every query with SQL of its own gives the same rows as DuckDB; the others run."""

import pytest

from tests.oracle import assert_same, connect
from tidewater import catalogue

SF = "/root/testdata/sf0.001"
CONNECTION = connect(SF)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, name):
    df = catalogue.queries()[name](spark, SF)
    if name in catalogue.oracle_sql():
        assert_same(df, catalogue.oracle_sql()[name], CONNECTION)
    else:
        assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and {"grade", "valid"} <= set(out.columns)
    assert set(catalogue.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
