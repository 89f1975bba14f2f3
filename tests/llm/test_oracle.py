"""Queries with SQL against DuckDB, and every query over the smallest tables."""

from collections import Counter

import duckdb
import pytest

from memspark.llm import queries as q

TABLES = "documents embeddings pages labels".split()


def plain(x):
    return None if x is None or str(x) in ("<NA>", "nan") else str(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = q.queries()[name](spark, sf_dir).toPandas(), con.execute(q.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (Counter(tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False)) for df in (got, want))
    assert a == b
