"""The driver's contract."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


def test_queries_and_sql_agree_in_name():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
