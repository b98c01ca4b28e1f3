"""The operators that SQL can express, against DuckDB on whole tables."""

import duckdb
import pytest

from tidemark.llm import queries

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_matches_oracle(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    df = queries.QUERIES[key](spark, D)
    res = con.execute(queries.ORACLE[key])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(res.fetchall())
