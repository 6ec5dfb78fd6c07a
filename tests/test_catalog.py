"""Every query of the catalogue against its SQL on the smallest tables; queries without SQL must run."""

import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpusloom.plans import catalog, models, networks  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "\0"
        if isinstance(v, float | np.floating):
            return str(int(v)) if float(v).is_integer() else repr(float(f"{v:.9g}"))
        return str(v)

    out = frame[sorted(frame.columns)].astype(object).map(text)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).is_dir():
        pytest.skip(f"no tables in {DATA}")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLES:
        assert len(got.columns) > 1
        return
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(canonical(got), canonical(want))
