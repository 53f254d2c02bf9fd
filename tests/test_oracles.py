"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from parleynet.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        return str(pd.Timestamp(x)) if hasattr(x, "year") else str(x)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, expected = registry.QUERIES[name](spark, SF_DIR).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    # The smallest documents have no sentence of two stand-in actors with a verb.
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0 or name == "mined_verbs"
