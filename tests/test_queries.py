import duckdb
import pytest

import __spark_entry__ as E
import check
from model import SF

# Those of the optional training-data operators have tests of their own.
OPTIONAL = {*E.LLM.QUERIES, "pipeline"} if E.LLM else set()
QUERIES = {name: query for name, query in E.queries().items() if name not in OPTIONAL}


@pytest.fixture(scope="module")
def db():
    from pathlib import Path

    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(E.oracle_sql()) - OPTIONAL == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    result = db.execute(E.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == check.rows_of(names, result.fetchall())


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0
