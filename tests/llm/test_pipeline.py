"""The registered queries of the subpackage, and the pipeline stage by stage."""

import re
from collections import Counter

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from pinmark.llm import registry, simhash
from tests.test_queries import FOLDER, TABLES, shown


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = contract.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    cursor = connection.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    places = sorted(range(len(names)), key=names.__getitem__)
    assert columns == sorted(names)
    expected = sorted(tuple(shown(r[i]) for i in places) for r in cursor.fetchall())
    assert sorted(tuple(map(shown, r)) for r in df.select(*columns).collect()) == expected


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(stage(spark, tables[-1], str(FOLDER)).cache())
        assert tables[-1].columns == docs.columns
    clean, unique, single, rest = tables[1:]
    ids = lambda df: {r.doc_id for r in df.collect()}
    squeezed = Counter(re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in unique.collect())
    assert set(squeezed.values()) == {1} and len(squeezed) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in clean.collect()})
    found = simhash.near_duplicates(unique)
    assert ids(single) == {r.component for r in found.collect()} and ids(rest) == ids(single)
    windows = Counter(tuple(w[i : i + 35]) for r in single.collect() for w in [r.text.split()] for i in range(len(w) - 34))
    lost = {r.doc_id for r in single.collect() for w in [r.text.split()] if any(windows[tuple(w[i : i + 35])] > 1 for i in range(len(w) - 34))}
    before = {r.doc_id: r.text for r in single.collect()}
    assert {r.doc_id for r in rest.collect() if r.text != before[r.doc_id]} == lost
    packed = corpus_pipeline.best_fit_packing(spark, rest, str(FOLDER))
    assert packed.groupBy().sum("length").first()[0] == sum(len(r.text.split()) for r in rest.collect())
