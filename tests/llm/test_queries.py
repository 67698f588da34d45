"""The registered queries and the pipeline on the smallest generated tables."""

import os
from pathlib import Path

import pytest

import corpus_pipeline
from emberlog.llm import queries

duckdb = pytest.importorskip("duckdb")
TABLES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="generated tables are not here")


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    found = queries.QUERIES[name](spark, str(TABLES)).toPandas()
    assert len(found)
    if name in queries.ORACLE_SQL:
        database = duckdb.connect()
        for file in TABLES.glob("*.parquet"):
            database.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
        expected = database.execute(queries.ORACLE_SQL[name]).df()[list(found.columns)]
        assert sorted(map(repr, found.astype(object).itertuples(index=False))) == sorted(map(repr, expected.astype(object).itertuples(index=False)))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(TABLES))
        if place < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    whole = corpus_pipeline.run(spark, str(TABLES))
    assert whole.count() == counts[-1]
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, docs.collect()))
