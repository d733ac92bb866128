"""The registered queries over whole tables: against their SQL, or their contract's own checks."""

import hashlib

import pytest
from conftest import SF_DIR
from oracle_check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from netlens.llm import near_dedup, pii
from netlens.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    rows, difference = compare(spark, con, QUERIES[name], ORACLE_SQL[name], SF_DIR)
    assert difference is None and rows > 0


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}


def test_fingerprint_query(spark):
    given = texts(spark)
    order = sorted(given, reverse=True)
    got = {r["doc_id"]: r for r in QUERIES["op2_fingerprint"](spark, SF_DIR).collect()}
    assert len(got) == len(given)
    by_text = {}
    for i, doc_id in enumerate(order):
        text, after = given[doc_id], given[order[(i + 1) % len(order)]]
        half = len(text) // 2
        r = got[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    mean = [sum(r[c] for r in got.values()) / len(got) for c in ("near_edited", "near_next")]
    assert 0.3 < mean[0] < 0.7 and mean[1] < 0.1


def test_pii_query(spark):
    given = texts(spark)
    for r in QUERIES["op3_pii"](spark, SF_DIR).collect():
        spans = pii.base_spans(given[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(pii.listed(spans).encode()).hexdigest()
        assert r["spans"].startswith(pii.listed(spans))


@pytest.mark.parametrize(("name", "column", "fold", "least"), [("op4_toxicity", "toxic", (5, 0), 0.5), ("op8_quality", "quality", (4, 2), 0.7)])
def test_classifier_queries(spark, name, column, fold, least):
    got = QUERIES[name](spark, SF_DIR)
    assert got.where((F.col("predicted") == 1) != (F.col("score") >= least)).count() == 0
    held = F.crc32(F.col("doc_id").cast("string")) % fold[0] == fold[1]
    assert got.where(F.col("held_out") != held).count() == 0 and got.where("score between 0 and 1").count() == 1_000
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", column)
    right = got.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0]
    assert right > 0.93  # a few hundred labels to learn from


def test_packing_query(spark):
    rows = QUERIES["op9_packing"](spark, SF_DIR)
    assert rows.where("length > 2048 or bit_count(length) <> 1 or `offset` <> 0").count() == 0
    per = rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert per.where("n <> t").count() == 0 and per.count() == 1_000


def test_html_query(spark):
    rows = QUERIES["op10_html_text"](spark, SF_DIR).collect()
    assert len(rows) == 250 and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    assert not any("©" in r["text"] or "<" in r["text"] for r in rows)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.schema.simpleString() == docs.schema.simpleString()
            assert after.join(docs, "doc_id", "left_anti").isEmpty()
        kept[name] = after.count()
        if name == "near_dedup":
            classes = near_dedup.classes(docs)
            assert after.select("doc_id").exceptAll(classes.where("kept").select("doc_id")).isEmpty()
            assert kept[name] == classes.where("kept").count()
        if name == "pii":
            left = [pii.base_spans(r["text"]) for r in after.select("text").collect()]
            assert not any(left) and after.where("n_chars <> length(text)").isEmpty()
        docs = after
    assert kept["quality"] > kept["near_dedup"] > kept["decontamination"] == kept["pii"]
    assert docs.select("doc_id").distinct().count() == kept["pii"]
