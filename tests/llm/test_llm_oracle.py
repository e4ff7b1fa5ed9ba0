"""Every query of the subpackage against its SQL, or for its rows."""

import pytest

import corpus_pipeline  # noqa: F401
from oracle import database, difference
from seclake.llm import queries  # noqa: F401
from seclake.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), database(sf), ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op4_secret_scan", "op5_toxicity", "op9_quality_classifier"])
def test_one_row_per_document(spark, sf, name):
    ids = [r.doc_id for r in QUERIES[name](spark, sf).select("doc_id").collect()]
    assert len(ids) == len(set(ids)) == 200


def test_pipeline_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.schema.simpleString() == docs.schema.simpleString()
        assert 0 < after.count() <= before.count()
        before = after
