import pytest

import __spark_entry__ as entry
from hindcast.plans import registry

duckdb = pytest.importorskip("duckdb")
TABLES = "event_records questions predictions raw_calls similarity_scores retrieval_requests retrieval_hits actors actor_profiles model_windows documents".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.5f}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
