"""Every stage of the pipeline on an empty table, on awkward rows, and with clashing columns."""

import pytest
from conftest import SF_DIR
from tables import DOCS, odd_rows, with_clashes

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_an_empty_table(spark, name):
    docs = with_clashes(spark.createDataFrame([], DOCS))
    out = STAGES[name](spark, docs, SF_DIR)
    assert out.count() == 0
    if name != "packing":
        assert out.schema.simpleString() == docs.schema.simpleString()


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_odd_rows(spark, name):
    docs = odd_rows(spark)
    out, wide = (STAGES[name](spark, d, SF_DIR) for d in (docs, with_clashes(docs)))
    if name == "packing":
        assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        return
    assert wide.schema.simpleString() == with_clashes(docs).schema.simpleString()
    key = lambda df: sorted(map(repr, df.select("doc_id", "text").collect()))
    assert key(out) == key(wide)
    ids = [r["doc_id"] for r in out.collect()]
    if name == "near_dedup":
        assert ids.count(5) == 1 and None in ids
    if name in ("decontamination", "pii"):
        assert len(ids) == docs.count()
