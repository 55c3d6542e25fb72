"""Operator queries with an oracle match DuckDB on the sf0.001 tables; every dealt operator is registered."""

import re

import duckdb
import pytest

from panelkit.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = con.execute(ORACLE[name]).df()
    plain = lambda df: df[sorted(df.columns)].astype(object).where(df.notna(), None)  # noqa: E731  (DuckDB's missing integers don't compare)
    rows = lambda df: sorted(map(tuple, plain(df).itertuples(index=False)), key=lambda r: [(x is None, x) for x in r])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)


def test_every_operator_is_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert "pipeline" in names
