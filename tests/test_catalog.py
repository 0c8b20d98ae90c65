"""Every registered query of the builder gives what its SQL gives in DuckDB."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from weir.plans import catalog, catalog_io

DATA = Path(os.environ.get("WEIR_TEST_DATA", "/root/testdata/sf0.001"))
ENTRIES = catalog.entries() | catalog_io.entries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    tidy = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, float | int) else str(v)
    return sorted((tuple(map(tidy, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_equals_its_sql(spark, duck, name):
    run, sql = ENTRIES[name]
    got, want = run(spark, str(DATA)).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
