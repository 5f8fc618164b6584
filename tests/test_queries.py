"""Registered queries over tables of the given schema that the tests make themselves."""

import datetime

from pyspark.sql import functions as F

from ledgerloom import registry
from ledgerloom.ledger import staged_ledger
from ledgerloom.plans import shared


def order_tables(spark, folder, lines):
    """The order tables with one order per line of (order, day, price), all of one customer and one part."""
    at = lambda day: datetime.datetime.fromisoformat(day)
    tables = {
        "nation": ("n_nationkey int, n_name string", [(0, "NATION_0")]),
        "customer": ("c_custkey long, c_name string, c_nationkey int", [(0, "Customer#0", 0)]),
        "part": ("p_partkey long, p_name string, p_brand string", [(0, "blue bolt", "Brand#1")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz", [(key, 0, at(day)) for key, day, _ in lines]),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
            "l_returnflag string, l_shipdate timestamp_ntz", [(key, 0, 0, 1, 2.0, price, 0.0, "N", at(day)) for key, day, price in lines],
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_a_row_id_whose_hash_has_no_absolute_value(spark, tmp_path):
    folder = order_tables(spark, tmp_path, [(7964242336, "1998-02-06", 10.5), (1, "1998-02-06", 4.0), (2, "1998-02-07", 2.0)])
    assert staged_ledger(spark, folder).select(F.min(F.hash("row_id"))).first()[0] == -(2**31)
    made = registry.csv_ledger(spark, folder).agg(F.sum("n_rows"), F.sum("amount")).first()
    assert tuple(made) == (3, 16.5)
    assert registry.csv_ingest_stats(spark, folder).first()["rows_read"] == 3
    for arriving in (registry.arriving_files, registry.arriving_rows):
        assert [r["current_revenue"] for r in arriving(spark, folder).collect()] == [16.5]


def test_voucher_files_are_compressed_and_read_whole(spark, tmp_path):
    keys = [k for k in range(40) if k % 9 and k % 11 and k % 13]  # plain sales with a party
    folder = order_tables(spark, tmp_path / "in", [(k, f"2001-01-{k % 28 + 1:02d}", 1.0 + k) for k in keys])
    made = registry.voucher_files(spark, folder)
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(made).select("path").collect()
    assert names and all(r["path"].endswith(".xml.gz") for r in names)
    assert registry.xml_ledger(spark, folder).agg(F.sum("amount")).first()[0] == sum(1 + k for k in keys)
    assert registry.xml_ingest_stats(spark, folder).first()["vouchers_found"] == len(keys)
    assert registry.arriving_vouchers(spark, folder).count() == 1


def test_a_staged_table_lets_go_of_its_shuffles(spark):
    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before, setting = shuffles(), spark.conf.get(shared.REMOVES_SHUFFLES, None)
    table = shared.staged(spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    assert table.count() == 7
    assert spark.conf.get(shared.REMOVES_SHUFFLES, None) == setting
    assert shuffles() <= before + 1
