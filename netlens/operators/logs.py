"""Changes to the log table as DataFrame operations.

Every function takes the current table and a batch of changes and returns
DataFrames; the caller writes the result to a new folder.  A batch is applied
as a whole: path ids are checked against the table as it was before the batch,
and of several changes to one row the last one stays.

Changes are small next to the table, so the table is reduced to the touched
ids by a semi join with the batch.  Batches are stored first where the table
meets them: Spark then knows their size and broadcasts a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LOG_MAX_LENGTH, LOG_NOT_NULL, LOGS
from ..session import stored
from .ids import assign_ids
from .lookup import exists_flag

LOG_COLUMNS = [f.name for f in LOGS]


def get_log(logs: DataFrame, log_id: int) -> DataFrame:
    """The row with this id, or no row."""
    return logs.filter(F.col("id") == log_id)


def with_defaults(df: DataFrame) -> DataFrame:
    """All log columns; ``timestamp`` and ``created_at`` default to now."""
    missing = {
        f.name: F.lit(None).cast(f.dataType) for f in LOGS if f.name not in df.columns
    }
    df = df.withColumns(missing) if missing else df
    now = F.localtimestamp()
    return df.withColumns(
        {
            "timestamp": F.coalesce("timestamp", now),
            "created_at": F.coalesce("created_at", now),
        }
    )


def violations(columns: list[str]) -> Column:
    """Names of the broken column constraints, e.g. ``sourceip not null``.

    A column that is not in ``columns`` counts as null.
    """

    def value(c: str) -> Column:
        return F.col(c) if c in columns else F.lit(None).cast("string")

    missing = [F.when(value(c).isNull(), F.lit(f"{c} not null")) for c in LOG_NOT_NULL]
    too_long = [
        F.when(F.length(value(c)) > n, F.lit(f"{c} max {n}")) for c, n in LOG_MAX_LENGTH.items()
    ]
    return F.array_compact(F.array(*missing, *too_long))


def validate_logs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``; the rejected rows keep their ``violations``."""
    checked = df.withColumn("violations", violations(df.columns))
    valid = checked.filter(F.size("violations") == 0).drop("violations")
    return valid, checked.filter(F.size("violations") > 0)


def insert_logs(rows: DataFrame, last_id: int, order_by: list[str] | None = None) -> DataFrame:
    """New log rows with ids after ``last_id``; any id they carry is replaced."""
    numbered = assign_ids(rows.drop("id"), last_id, order_by)
    return with_defaults(numbered).select(LOG_COLUMNS)


def _touched(logs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those ids of ``wanted(id)`` that exist in the table."""
    ids = wanted.filter(F.col("id").isNotNull()).distinct()
    return logs.select("id").join(ids, "id", "left_semi")


def save_changes(
    logs: DataFrame, rows: DataFrame, last_id: int, seq: str = "seq"
) -> DataFrame:
    """The rows that a save of ``rows`` writes, with their final ids.

    A row whose id exists replaces that row in full; a row without an id, or
    with an id the table does not have, becomes a new row with a new id.  New
    ids follow ``seq``, which must be unique in the batch.
    """
    known = exists_flag(
        rows, _touched(logs, rows.select("id")), "id", "id", "_exists", spread_by=seq
    )
    replacing = known.filter("_exists").drop("_exists")
    # Narrow rows are combined before the shuffle, so a row changed very often
    # in one batch does not gather its versions in one task.
    newest = replacing.groupBy("id").agg(F.max(seq).alias("_newest")).select("_newest")
    replaced = with_defaults(
        replacing.join(newest, F.col(seq) == F.col("_newest"), "left_semi")
    )
    new = insert_logs(known.filter(~F.col("_exists")).drop("_exists"), last_id, [seq])
    return replaced.select(LOG_COLUMNS).unionByName(new)


def upsert_changes(
    logs: DataFrame, updates: DataFrame, last_id: int, seq: str = "seq"
) -> DataFrame:
    """The rows that a batch of updates ``(path_id, id, body...)`` writes.

    ``path_id`` is only an existence check; what is saved is the body, under the
    body's own id (see :func:`save_changes`).
    """
    checked = exists_flag(
        updates,
        _touched(logs, updates.select(F.col("path_id").alias("id"))),
        "path_id",
        "id",
        "_found",
        spread_by=seq,
    )
    rows = checked.filter("_found").drop("_found", "path_id")
    return save_changes(logs, rows, last_id, seq)


def without_ids(logs: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without the given ids."""
    return logs.join(ids.select("id").distinct(), "id", "left_anti")


def apply_changes(logs: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after ``changes`` replaced or added their rows."""
    return without_ids(logs, changes).select(LOG_COLUMNS).unionByName(changes)


def upsert_logs(
    logs: DataFrame, updates: DataFrame, last_id: int, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """``(the table after a batch of updates, rejected updates)``.

    An update that breaks a column constraint changes nothing and comes back with its
    ``violations``.
    """
    valid, rejected = validate_logs(updates)
    changes = stored(upsert_changes(logs, valid, last_id, seq), "log-changes")
    return apply_changes(logs, changes), rejected


def save_logs(
    logs: DataFrame, rows: DataFrame, last_id: int, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """``(the table after full rows are saved, rejected rows)``: by existing id, else as new rows."""
    valid, rejected = validate_logs(rows)
    changes = stored(save_changes(logs, valid, last_id, seq), "log-changes")
    return apply_changes(logs, changes), rejected


def delete_logs(logs: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without the given ids; unknown ids change nothing."""
    return without_ids(logs, ids)
