"""The corpus pipeline: five stages from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of ``documents`` unchanged in name and type, but for the last, which returns pieces. Each
result is written as Parquet and read again by the next stage.

Null and empty texts go through all stages where the quality model keeps them: they have no
near-duplicate, no benchmark passage and nothing to mask, and pack as one end id. Rows that repeat
an id and a text become one in the second stage; rows without an id all stay there. Other columns
pass, whatever their names. An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm import decontaminate, near_dedup, packing, pii, quality
from netlens.llm.common import id_remainder, prepare, table
from netlens.llm.queries import TOKENIZER
from netlens.session import stored

#: Parts that the tokenizer remembers: fewer than alone, as the workers served other stages before.
CACHE_PARTS = 100_000
#: Least quality score of a document that stays.
LEAST_QUALITY = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out what the quality classifier rejects."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.keep_good(docs, quality.fit(docs, labels.where(id_remainder(4) != 2)), LEAST_QUALITY)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates."""
    prepare(spark)
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a passage of the benchmark."""
    prepare(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and terms that disclose it, by marks; n_chars follows the text."""
    prepare(spark)
    out = pii.sanitise(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of a power of two."""
    prepare(spark)
    return packing.pack(docs, TOKENIZER, cache_parts=CACHE_PARTS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, stage = STAGES[-1]
    return stored(stage(spark, docs, sf_dir), f"pipeline-{name}")


#: The classifier and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None
