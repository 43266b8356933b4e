"""Every query of the library against DuckDB on the same tables; those without SQL must run."""

import pytest
from conftest import TINY
from tidemark import queries as own

SLOW = {"ml_scores", "ml_confusion"}  # trained in test_ml


def rows_of(frame):
    columns = sorted(frame.columns)
    text = frame[columns].astype(str).replace({"None": "~", "nan": "~", "<NA>": "~", "NaT": "~"})
    return columns, sorted(map(tuple, text.values.tolist()))


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, duck, name):
    if name in SLOW:
        pytest.skip("covered by test_ml")
    got = own.queries()[name](spark, TINY).toPandas()
    if name in own.oracle_sql():
        assert rows_of(got) == rows_of(duck.sql(own.oracle_sql()[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
