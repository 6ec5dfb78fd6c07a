import os

import pytest

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 60


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="no tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["year", "total_a", "total_b", "jsd", "tv", "cosine"] and df.count() > 0
