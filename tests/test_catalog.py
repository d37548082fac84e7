"""Each query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from loomquery import catalog, oracles

SF = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([None if pd.isna(v) else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in r]) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(oracles.SQL[name]).df())
