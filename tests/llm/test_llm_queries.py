"""The operators' queries with SQL against DuckDB, and that all of them run."""

import duckdb
import pytest

from quillspark.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    got = df.collect()
    assert got
    if name in SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations", "embeddings", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        run = con.execute(SQL[name])
        names, rows = [c[0] for c in run.description], run.fetchall()
        order = sorted(df.columns)
        assert sorted(repr([r[c] for c in order]) for r in got) == sorted(repr([r[names.index(c)] for c in order]) for r in rows)
