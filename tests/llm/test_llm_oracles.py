"""Operators with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from parleynet.llm import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "sale_lines"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    got, expected = registry.QUERIES[name](spark, SF_DIR).toPandas(), con.execute(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    # A whole number is one whether its column has nulls or not.
    text = lambda x: "null" if x is None or x != x else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    plain = lambda f: sorted(str([text(x) for x in r]) for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None))
    assert plain(got) == plain(expected)
