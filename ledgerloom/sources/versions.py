"""Stored tables whose changes rewrite only the buckets they touch; readers see one version or the next, never a mixture.

A version is a small table that says, for every bucket of keys, in which version its rows were written last. A change reads the touched
buckets, writes their new rows below its own number, and then publishes the version in one file; until that file is there, readers go on
with the version before. A change that failed half way leaves rows that no version names, and the next try replaces them.
One writer at a time: publishing a number that is there already is an error.
"""

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
POINTER = "bucket int, written int, kind string"


class VersionedTable(NamedTuple):
    """A table laid out by the buckets of one key column. The number of buckets is fixed when the table is made."""

    path: str
    key: str
    buckets: int = BUCKETS

    def bucket(self, key: str | Column | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> int:
        self._write(rows, 0)
        return self._publish(rows.sparkSession, rows.schema, 0, {}, range(self.buckets))

    def latest(self, spark: SparkSession) -> int:
        return spark.read.schema(f"{POINTER}, version int").parquet(f"{self.path}/versions").agg(F.max("version")).first()[0]

    def read(self, spark: SparkSession, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the latest unless given; of some buckets only if asked to."""
        pointer, schema = self._pointer(spark, self.latest(spark) if version is None else version)
        folders = [
            f"{self.path}/rows/version={written}/bucket={bucket}" for bucket, written in pointer.items()
            if written is not None and (buckets is None or bucket in buckets)
        ]
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def change(self, touched: DataFrame, work: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the buckets that hold a key of `touched` by what `work` makes of their rows; returns the new version.

        Keys that `work` adds must be among the touched ones.
        """
        spark = touched.sparkSession
        version = self.latest(spark)
        pointer, schema = self._pointer(spark, version)
        hit = [row[0] for row in touched.select(self.bucket().alias("b")).distinct().collect()]  # at most as many as buckets
        if not hit:
            return version
        rows = work(self.read(spark, version, hit)).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        stray = F.when(self.bucket().isin(hit), F.lit(True)).otherwise(F.raise_error(F.lit("a row outside of the touched buckets")).cast("boolean"))
        self._write(rows.filter(stray), version + 1)
        return self._publish(spark, schema, version + 1, pointer, hit)

    def _pointer(self, spark: SparkSession, version: int) -> tuple[dict[int, int | None], T.StructType]:
        rows = spark.read.schema(POINTER).parquet(f"{self.path}/versions/version={version}").collect()  # one per bucket
        return {r["bucket"]: r["written"] for r in rows}, T.StructType.fromJson(json.loads(rows[0]["kind"]))

    def _write(self, rows: DataFrame, version: int) -> None:
        """Large buckets are cut by their measured size, so that a hot key gets as many writers as its rows need."""
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/rows/version={version}")

    def _publish(self, spark: SparkSession, schema: T.StructType, version: int, pointer: dict[int, int | None], hit) -> int:
        new = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/rows/version={version}")
        filled = {row[0] for row in new.select("bucket").distinct().collect()}
        written = {**dict.fromkeys(range(self.buckets)), **pointer, **{b: version if b in filled else None for b in hit}}
        rows = [(b, w, schema.json()) for b, w in written.items()]
        spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/version={version}")
        return version
