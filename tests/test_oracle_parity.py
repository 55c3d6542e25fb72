"""Every registered query with an oracle matches DuckDB on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E
from panelkit.plans import QUERIES
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(df: pd.DataFrame):
    def cv(v):
        if v is None or v is pd.NA or v is pd.NaT:
            return "~"
        if isinstance(v, (float, np.floating)):
            return "~" if math.isnan(v) else round(float(v), 5)
        if isinstance(v, (bool, np.bool_, int, np.integer)):
            return float(int(v))
        return str(v)
    df = df[sorted(df.columns)]
    return sorted((tuple(cv(v) for v in r) for r in df.itertuples(index=False)), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n in QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _norm(got) == _norm(want)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["outcome", "twfe_5yr_effect", "twfe_p_value", "att", "att_p_value"]


def test_every_query_of_the_library_has_an_oracle():
    from panelkit.plans import ORACLE, QUERIES
    assert set(QUERIES) == set(ORACLE)
