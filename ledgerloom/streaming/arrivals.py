"""Arriving ledger files: every new file is parsed once and the tenants it touches are analysed again."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.joins import lookup_join, releasing
from ledgerloom.sources.delimited import ROW_IN_SPLIT, parse_rows, usable
from ledgerloom.sources.tables import write_results


def csv_arrivals(spark: SparkSession, folder: str, columns: list[str], sep: str = ",") -> DataFrame:
    """Raw text rows of the files that appear in a folder, with their file and split."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.readStream.schema(schema).options(header=True, sep=sep, escape='"', multiLine=True, enforceSchema=False).csv(folder)
    return rows.withColumns(
        {"source": F.col("_metadata.file_path"), "_split": F.col("_metadata.file_block_start")}
    )


def on_arrival(
    arrivals: DataFrame,
    columns: list[str],
    tenant: Column,
    store: str,
    analyse: Callable[[DataFrame, int], None],
    checkpoint: str,
    column_map: dict[str, str] | None = None,
) -> StreamingQuery:
    """Append parsed rows to the ledger table in `store`; then call `analyse` with the ledgers of touched tenants.

    Every micro-batch writes its own folder, so a batch run again after a failure replaces its rows instead of adding
    them twice.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        position = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_IN_SPLIT))
        placed = batch.withColumn("row_id", F.format_string("%s:%015d:%012d", "source", "_split", position))
        rows = parse_rows(placed, columns, tenant, column_map).filter(usable())
        write_results(rows, f"{store}/batch={batch_id}")
        spark = batch.sparkSession
        new = spark.read.parquet(f"{store}/batch={batch_id}")
        # At most TENANT_BUCKETS numbers; only the folders of these buckets are read again.
        buckets = [row[0] for row in new.select("tenant_bucket").distinct().collect()]
        ledger = spark.read.option("basePath", store).parquet(store).filter(F.col("tenant_bucket").isin(buckets))
        touched = new.select("tenant").distinct()
        with releasing():
            analyse(
                lookup_join(ledger, touched, ["tenant"], spread_by=["row_id"]).drop("batch", "tenant_bucket"), batch_id
            )

    return (
        arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
