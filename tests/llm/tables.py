"""Small hand-made tables with every awkward row: nulls, empties, repeats, long texts, extra columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    letters = str.maketrans("0123456789", "abcdefghij")
    return " ".join(f"w{rng.randrange(vocabulary)}".translate(letters) for _ in range(n))


def documents(spark: SparkSession, texts: list[str | None], first: int = 0) -> DataFrame:
    rows = [(first + i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def odd_rows(spark: SparkSession) -> DataFrame:
    """Null id, null text, empty text, white space, one word, a repeated row, an id with two texts, a long text."""
    base = prose(1, 60)
    rows = [
        (None, base, "en", None, 1),
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "de", "a", 4),
        (4, "word", "fr", None, 4),
        (5, base, "en", "a", None),
        (5, base, "en", "a", None),
        (6, prose(2, 50), "en", "a", 5),
        (6, prose(3, 50), "en", "b", 5),
        (7, prose(4, 30_000), "en", "b", 5),
        (8, "é   ü! ñ 1234 😀", "es", "b", 5),
        (9, "x" * 50_000, "es", "b", 5),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def with_clashes(df: DataFrame) -> DataFrame:
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["score", "n_words", "row_key", "text_hash", "bands", "key", "label", "bucket", "id", "component", "spans", "hit", "terms", "start",
             "_rows", "_id", "_kept", "_pii_terms", "_row_key", "_terms", "_part", "_rank", "gone", "parts", "total"]
    return df.select("*", *[F.lit(7).alias(n) for n in names])


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
