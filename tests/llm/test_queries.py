"""The registered queries against DuckDB where SQL can say the same."""

import duckdb
import pytest

from tidemark.llm import queries

TABLES = "documents pages benchmark labels conversations embeddings".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    found = duck.execute(queries.oracle_sql()[name])
    columns = sorted(d[0] for d in found.description)
    at = {d[0]: k for k, d in enumerate(found.description)}
    assert sorted(df.columns) == columns
    want = sorted(str([r[at[c]] for c in columns]) for r in found.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want


def test_there_are_ten():
    numbers = {int(n[2:].split("_")[0]) for n in queries.queries()}
    assert numbers == set(range(1, 11))
