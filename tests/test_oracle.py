"""Every registered query against its DuckDB oracle on the smallest fixture."""

import hashlib
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tallyframe.sources.tables import FIXTURE_TABLES

from .conftest import SF_SMALL

NAMES = sorted(queries())
ORACLES = oracle_sql()


def _canon(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float) or (isinstance(v, (int, np.integer)) and not isinstance(v, bool) and abs(v) < 1 << 53):
        return repr(round(float(v), 6))  # a column of integers with nulls comes as floats from one side
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return repr(v)


def _digest(pdf):
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_canon(r[c]) for c in cols) for r in pdf.to_dict("records"))
    return cols, len(rows), hashlib.sha256("\n".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in FIXTURE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(NAMES)


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() >= 0
    assert "activity_type" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    got = queries()[name](spark, SF_SMALL).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(ORACLES[name]).df()
    assert _digest(got) == _digest(want)
