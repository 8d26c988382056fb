import pytest

from hindcast.llm import queries

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("event_records", "questions", "similarity_scores"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cursor = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    want = sorted(cursor.fetchall())
    assert want and sorted(tuple(r[n] for n in names) for r in df.collect()) == want
