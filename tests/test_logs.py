import datetime

import pytest
from pyspark.sql import functions as F

from netlens.operators.ids import assign_ids, number_in_place
from netlens.operators.logs import LOG_COLUMNS, delete_logs, save_logs, upsert_logs, validate_logs, with_defaults
from netlens.operators.views import display_logs, to_json_rows
from netlens.schema import LOGS
from netlens.session import stored
from netlens.sources.jdbc import jdbc_options
from netlens.sources.logtable import clear_logs, first_id, other_source, read_logs, stored_logs, write_logs, write_table

BODY = "seq long, sourceip string, destinationip string, protocol string, details string"
UPDATE = "seq long, path_id long, id long, sourceip string, destinationip string, protocol string, details string"


def bodies(spark, *texts, start=1):
    rows = [(start + i, "10.0.0.1", "10.0.0.2", "TCP", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, BODY)


def details(logs):
    return {r["id"]: r["details"] for r in logs.collect()}


@pytest.fixture
def logs(spark):
    """Rows 1 to 8."""
    return with_defaults(bodies(spark, *[f"row {i}" for i in range(1, 9)]).withColumn("id", F.col("seq"))).select(LOG_COLUMNS)


def test_ids_are_dense_and_ordered(spark):
    df = spark.range(10_000).select(F.col("id").alias("k"), (-F.col("id")).alias("o"))
    got = assign_ids(df.repartition(7), 41, ["o"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(42, 10_042))
    assert [r["k"] for r in got] == list(range(9_999, -1, -1))
    assert assign_ids(df.limit(0), 5, ["o"]).count() == 0
    free = assign_ids(df.repartition(5), 0).collect()
    assert sorted(r["id"] for r in free) == list(range(1, 10_001))


def test_number_in_place(spark):
    df = stored(spark.range(5_000).repartition(6), "numbered").filter("id % 3 = 0")
    got = number_in_place(df, 100, "n").collect()
    assert sorted(r["n"] for r in got) == list(range(100, 100 + len(got)))


def test_validation_limits(spark):
    limits = {
        "sourceip": 200, "sourcemac": 2000, "destinationip": 200, "destinationmac": 2000,
        "protocol": 100, "ipversion": 100, "details": 2000,
    }
    good = {c: "x" * n for c, n in limits.items()}
    rows = [good]
    rows += [{**good, c: "x" * (n + 1)} for c, n in limits.items()]
    rows += [{**good, c: None} for c in limits]
    df = spark.createDataFrame(
        [(i, *[r[c] for c in limits]) for i, r in enumerate(rows)],
        "k long, " + ", ".join(f"{c} string" for c in limits),
    )
    valid, rejected = validate_logs(df)
    nullable = ["sourcemac", "destinationmac", "ipversion"]
    expected = {0} | {8 + i for i, c in enumerate(limits) if c in nullable}
    assert {r["k"] for r in valid.collect()} == expected
    reasons = {r["k"]: r["violations"] for r in rejected.collect()}
    assert reasons[1] == ["sourceip max 200"] and reasons[8] == ["sourceip not null"]
    assert len(reasons) == len(rows) - len(expected)


def test_defaults(spark):
    df = with_defaults(bodies(spark, "x"))
    row = df.first()
    assert abs(row["created_at"] - datetime.datetime.now(datetime.UTC).replace(tzinfo=None)).total_seconds() < 60
    assert row["timestamp"] is not None
    assert dict(df.select(LOG_COLUMNS).dtypes) == {f.name: f.dataType.simpleString() for f in LOGS}


def test_written_batches(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = stored(bodies(spark, "a", "b", "x" * 2_001), "rows")
    for _ in range(2):  # a repeated batch replaces itself
        assert write_logs(rows, path, "one", 0).count() == 1
    write_logs(stored(bodies(spark, "c"), "rows"), path, "one", 1)
    write_logs(rows, path, "two", 0, writer=1)
    got = details(read_logs(spark, path))
    assert sorted(got.values()) == ["a", "a", "b", "b", "c"]
    assert {i for i, d in got.items() if d == "c"} == {first_id(1, 0) + 1}
    assert {r["source"]: r["count"] for r in stored_logs(spark, path).groupBy("source").count().collect()} == {"one": 3, "two": 2}
    assert other_source(spark, path, "one", 0) is None and other_source(spark, path, "three", 1) == "two"
    clear_logs(spark, path)
    assert read_logs(spark, path).count() == 0


def test_ids_have_room():
    assert first_id(0, 0) == 0 and first_id(1, 0) > first_id(0, 15) > first_id(0, 1) > 0
    assert first_id((1 << 28) - 1, 15) + (1 << 31) <= 1 << 63
    for bad in ((-1, 0), (1 << 28, 0), (0, 16)):
        with pytest.raises(ValueError):
            first_id(*bad)


def test_upsert_cases(spark, logs):
    rows = [
        (1, 5, 5, "row 5 replaced"),
        (2, 5, 7, "row 7 replaced through path 5"),
        (3, 5, None, "new, no id"),
        (4, -1, 6, "unknown path"),
        (5, 5, 10_000, "id not in the table"),
        (6, 1, 2, "first version"),
        (7, 1, 2, "last version"),
        (8, 3, 3, None),
    ]
    updates = spark.createDataFrame([(s, p, i, "a", "b", "UDP", d) for s, p, i, d in rows], UPDATE)
    after, rejected = upsert_logs(logs, updates, 8)
    assert details(after) == {
        1: "row 1", 2: "last version", 3: "row 3", 4: "row 4", 5: "row 5 replaced", 6: "row 6",
        7: "row 7 replaced through path 5", 8: "row 8", 9: "new, no id", 10: "id not in the table",
    }
    row = after.filter("id = 5").first()
    assert (row["sourceip"], row["protocol"], row["sourcemac"]) == ("a", "UDP", None)
    assert [(r["seq"], r["violations"]) for r in rejected.collect()] == [(8, ["details not null"])]


def test_save_without_path_check(spark, logs):
    rows = spark.createDataFrame(
        [(1, 3, "a", "b", "UDP", "saved"), (2, None, "a", "b", "UDP", "new"), (3, 4, None, "b", "UDP", "refused")],
        UPDATE.replace("path_id long, ", ""),
    )
    after, rejected = save_logs(logs, rows, 8)
    got = details(after)
    assert (got[3], got[4], got[9], len(got)) == ("saved", "row 4", "new", 9)
    assert rejected.count() == 1


def test_delete(spark, logs, tmp_path):
    ids = spark.createDataFrame([(2,), (-1,), (2,), (8,)], "id long")
    write_table(delete_logs(logs, ids), str(tmp_path / "left"))
    assert details(read_logs(spark, str(tmp_path / "left"))) == {i: f"row {i}" for i in (1, 3, 4, 5, 6, 7)}


def test_display_and_json(spark, logs):
    shown = display_logs(logs)
    assert shown.columns[1:] == [
        "timestamp", "sourceip", "sourcemac", "destinationip", "destinationmac", "ipversion", "protocol", "details",
    ]
    text = to_json_rows(logs.filter("id = 1")).first()["value"]
    assert '"sourcemac":null' in text and '"createdAt":' in text


def test_seed_row_is_not_an_address(spark):
    seed = spark.createDataFrame([(1, "Atlantis", "Lemuria", "HTTP", "text")], BODY)
    valid, rejected = validate_logs(seed)
    assert valid.count() == 1 and rejected.count() == 0


def test_jdbc_options():
    assert jdbc_options("jdbc:postgresql://db/monitor", "logs", batchsize=5000) == {
        "url": "jdbc:postgresql://db/monitor", "dbtable": "logs", "batchsize": "5000",
    }
