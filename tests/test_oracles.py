"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from corvane.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are missing")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect(config={"threads": 2, "memory_limit": "4GB", "max_temp_directory_size": "1GB"})
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    def shown(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return repr(round(v, 9))
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

    df = df[sorted(df.columns)].astype(object).map(shown)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_sql(spark, duck, name):
    mine, theirs = normal(catalog.queries()[name](spark, str(DATA)).toPandas()), normal(duck.sql(catalog.oracles()[name]).df())
    pd.testing.assert_frame_equal(mine, theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, str(DATA)).count() > 0
