"""Every query with SQL against DuckDB on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusloom.plans.queries import QUERIES, SQL  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return c


def same(v):
    return round(v, 6) if isinstance(v, float) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(same(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    assert all(set(r.asDict()) == set(df.columns) for r in df.collect())
    assert df.count() > 0


def test_flagship_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark, tiny):
    """Two columns of documents are read for a count by source."""
    plan = QUERIES["a11_count_by_source"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan and "lang" not in plan.split("ReadSchema")[-1]
