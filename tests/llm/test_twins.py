"""The queries that SQL can express give what their SQL gives in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from weir.llm import queries

DATA = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list[str]:
    return sorted(repr([None if pd.isna(v) else str(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    whole = [c for c in got.columns if got[c].dtype.kind in "if"]  # nullable ids come as floats on either side
    got[whole], want[whole] = got[whole].astype("Float64"), want[whole].astype("Float64")
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
