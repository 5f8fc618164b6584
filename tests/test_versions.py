import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.versions import VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    made = VersionedTable(str(tmp_path / "t"), "k", 8)
    made.create(spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    return made


def values(rows):
    return {r["k"]: r["v"] for r in rows.collect()}


def test_a_change_rewrites_touched_buckets_only(spark, table):
    touched = spark.range(3, 4).select(F.col("id").alias("k"))
    assert table.change(touched, lambda old: old.withColumn("v", F.when(F.col("k") == 3, "b").otherwise(F.col("v")))) == 1
    assert values(table.read(spark)) == {k: "b" if k == 3 else "a" for k in range(100)}
    assert set(values(table.read(spark, 0)).values()) == {"a"}
    folders = [f for f in os.listdir(f"{table.path}/rows/version=1") if f.startswith("bucket=")]
    assert len(folders) == 1
    untouched = [f for f in table.read(spark).inputFiles() if "version=0" in f]
    assert len({f.split("bucket=")[1].split("/")[0] for f in untouched}) == 7


def test_emptied_buckets_and_no_change(spark, table):
    every = table.read(spark).select("k")
    assert table.change(every.limit(0), lambda old: old) == 0
    assert table.change(every, lambda old: old.filter("false")) == 1
    assert table.read(spark).columns == ["k", "v"] and table.read(spark).count() == 0 and table.read(spark, 0).count() == 100
    back = spark.createDataFrame([(5, "c")], "k long, v string")
    table.change(back, lambda old: old.unionByName(back))
    assert values(table.read(spark)) == {5: "c"}


def test_a_failed_change_is_not_seen_and_can_be_tried_again(spark, table, monkeypatch):
    touched = spark.range(2).select(F.col("id").alias("k"))

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_publish", broken)
        with pytest.raises(OSError):
            table.change(touched, lambda old: old.withColumn("v", F.lit("x")))
    assert table.latest(spark) == 0 and set(values(table.read(spark)).values()) == {"a"}
    table.change(touched, lambda old: old.withColumn("v", F.when(F.col("k") < 2, "y").otherwise(F.col("v"))))
    assert sorted(k for k, v in values(table.read(spark)).items() if v == "y") == [0, 1]


def test_rows_outside_of_the_touched_buckets_are_an_error(spark, table):
    touched = spark.range(1).select(F.col("id").alias("k"))
    everywhere = spark.range(200, 240).select(F.col("id").alias("k"), F.lit("n").alias("v"))
    with pytest.raises(Exception, match="touched buckets"):
        table.change(touched, lambda old: old.unionByName(everywhere))
    assert table.latest(spark) == 0
