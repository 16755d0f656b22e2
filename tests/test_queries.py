"""Every registered query with SQL, against DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from shiftlens.plans import catalogue


def canon(df: pd.DataFrame) -> list[str]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__module__ == "numpy" and getattr(v, "dtype", None) is not None and v.dtype.kind in "iuf":
            return f"{float(v):.9g}"
        return str(v)

    df = df[sorted(df.columns)]
    return sorted("|".join(map(cell, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, sf, name):
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    want = con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    assert __spark_entry__.queries()[name](spark, sf).count() > 0

