"""The log table in a relational database (optional; needs a driver on the classpath).

No database is available where the tests run, so only the options built here
are checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, table: str, **extra: str) -> dict[str, str]:
    return {"url": url, "dbtable": table, **{k: str(v) for k, v in extra.items()}}


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str = "logs",
    id_range: tuple[int, int] | None = None,
    partitions: int = 1,
    **extra: str,
) -> DataFrame:
    """Read the table, split by ``id`` over ``partitions`` connections.

    ``id_range`` only sets the stride; rows outside it are read as well.
    """
    options = jdbc_options(url, table, **extra)
    if id_range is not None:
        options |= {
            "partitionColumn": "id",
            "lowerBound": str(id_range[0]),
            "upperBound": str(id_range[1]),
            "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(**options).load()


def write_jdbc(df: DataFrame, url: str, table: str = "logs", **extra: str) -> None:
    """Append rows; leave ``id`` out so that the database numbers them."""
    options = jdbc_options(url, table, **extra)
    df.drop("id").write.format("jdbc").options(**options).mode("append").save()
