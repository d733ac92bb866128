import os

from netlens import session
from netlens.session import RUNTIME_SETTINGS, remove_scratch, scratch_dir, shared_dir, stored, tune


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert scratch_dir(spark, "x").startswith(f"{named}/x-")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_tune(spark):
    tune(spark)
    assert all(spark.conf.get(k) == v for k, v in RUNTIME_SETTINGS.items())


def test_stored_keeps_rows_and_schema(spark):
    df = spark.sql("select id, cast(null as string) as text, array(id) as xs from range(10)")
    back = stored(df, "kept")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(back.collect()) == sorted(df.collect())


def test_scratch_is_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_SCRATCH", [])
    stored(spark.range(5), "short")
    folder = session._SCRATCH[0]
    assert os.path.isdir(folder)
    remove_scratch(spark)
    assert not os.path.exists(folder) and not session._SCRATCH
