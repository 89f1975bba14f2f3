"""Every query with SQL against DuckDB over the same tables."""

from collections import Counter

import duckdb
import pytest

from memspark.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df, cols):
    def plain(x):
        if x is None or str(x) in ("<NA>", "NaT", "nan"):
            return "null"
        return str(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)

    return Counter(tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got, want = plans.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(plans.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert rows(got, cols) == rows(want, cols)


def test_entry_has_rows_and_llm_is_optional(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(plans.QUERIES) <= set(e.queries())
