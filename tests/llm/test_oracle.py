"""Operators that SQL can express, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from tests.helpers import same_rows
from timeloom.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, sf_dir, name):
    same_rows(queries()[name](spark, sf_dir), oracle_sql()[name], sf_dir)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        assert 0.7 * kept <= after.count() <= kept, name
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert 0 < got.count() <= kept
    texts = duckdb.connect().execute(f"SELECT count(DISTINCT text) FROM '{sf_dir}/documents.parquet'").fetchone()[0]
    assert got.count() <= texts
