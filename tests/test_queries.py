"""Every registered query against its SQL statement in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as contract
from pinmark.plans import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
FOLDER = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def shown(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return f"{type(value).__name__} {value}"


def test_each_query_has_a_statement():
    assert set(catalog.oracles()) == set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    found = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    cursor = duck.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    places = sorted(range(len(names)), key=names.__getitem__)
    expected = sorted(tuple(shown(r[i]) for i in places) for r in cursor.fetchall())
    assert columns == sorted(names)
    assert found == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0
