"""Bounded samples, labels and names, and a corpus of many languages."""

import pytest
from pyspark.sql import functions as F
from tables import documents, prose

from netlens.llm import langid, pii
from netlens.llm.common import bounded_sample, free_names, one_label


def test_sample_is_the_smallest_hashes_of_each_value(spark):
    rows = spark.range(5_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 7)).alias("lang"), F.lit(1).alias("_rank"))
    got = bounded_sample(rows, "lang", 40)
    assert got.columns == rows.columns
    for value in ("hot", "v0", "v6"):
        want = rows.where(F.col("lang") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(40)
        assert got.where(F.col("lang") == value).exceptAll(want).isEmpty() and got.where(F.col("lang") == value).count() == 40
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") + plan.count("Range") == 1


def test_of_two_labels_the_smaller(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, None), (None, 1), (4, 7)], "doc_id long, label int")
    assert sorted(map(tuple, one_label(labels).collect())) == [(1, 0), (2, 1)]


def test_free_names(spark):
    df = spark.createDataFrame([], "_ID int, _id_ int, x int")
    assert free_names(df, "_id", "_rows", "X") == ["_id__", "_rows", "X_"]


def test_many_languages(spark):
    docs = documents(spark, [prose(i, 20) for i in range(1_200)]).withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 1_150).cast("string")))
    model = langid.fit(docs, sample_rows=5)
    assert len(model.languages) == 1_150


@pytest.mark.parametrize("word", ["İstanbulova", "STRASSEẞ", "ΣΑΣ"])
def test_a_term_is_counted_as_it_is_found(spark, word):
    near = {t for _, t in pii.near_terms(f"{word} writes from a@b.example here")}
    assert pii.term_of(word) in near
    texts = [f"{word} writes from a@b.example number {i}" for i in range(6)] + [prose(i, 30) for i in range(60)]
    terms = {r["term"] for r in pii.disclosing_terms(documents(spark, texts)).collect()}
    assert pii.term_of(word) in terms
