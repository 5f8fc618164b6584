"""Two-pass external shuffle: scatter rows over memory-sized buckets by a seeded hash, Fisher-Yates each bucket, cut.

Pass one hashes every row, with its running number, to a bucket; pass two holds one bucket's rows as an array, shuffles it
(Spark's shuffle() is a Fisher-Yates) and writes it. The buckets one after the other are the shuffled stream, and shards
are equal cuts of it: row counts of shards differ by one at most. All steps are DataFrame operations.

Defined results: an empty table gives no rows; null ids and texts, repeated rows, ties and groups of copies of any size are
scattered like any other row, since the running number is part of the hash. A row longer than a bucket fills its own. Columns
named like a result are replaced by it. The input should be a table in files, so that running numbers are the same when
a lost task is run again.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import shielded
from ledgerloom.plans.shared import staged

SHARDS = 24
SEED = 42
# What one task holds as an array at a time; a row counts with its text and 64 bytes besides.
BUCKET_BYTES = 16 << 20
ROW_BYTES = 64
# Starts of buckets are broadcast, 16 bytes each; beyond this many buckets, buckets grow instead.
MAX_BUCKETS = 1_000_000


def external_shuffle(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, text: str = "text") -> DataFrame:
    """All rows in uniformly random order, numbered from 0 as `position`; written once to the shared folder."""
    return shielded(docs, [text], lambda d, _: _shuffled(d, seed, bucket_bytes, text))


def _shuffled(docs: DataFrame, seed: int, bucket_bytes: int, text: str) -> DataFrame:
    size = docs.select(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).alias("n")).first()["n"] or 0
    buckets = min(int(size // bucket_bytes) + 1, MAX_BUCKETS)
    number = F.monotonically_increasing_id()
    row = F.struct(F.col("_number"), F.struct(*docs.columns).alias("r"))
    scattered = (
        docs.withColumn("_number", number)
        .withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_number"), F.lit(buckets)).cast("int"))
        .repartition(buckets, "_bucket")
        .groupBy("_bucket")
        .agg(F.collect_list(row).alias("_listed"))
    )
    # Sorted by number alone: rows may hold values without an order, such as maps.
    order = F.array_sort(F.transform("_listed", lambda r, i: F.struct(r["_number"], i.alias("i"))))
    scattered = scattered.select("_bucket", F.transform(order, lambda o: F.get("_listed", o["i"])).alias("_rows"))
    shuffled = staged(
        scattered.select("_bucket", F.posexplode(F.shuffle("_rows", seed)).alias("_place", "_row")).select("_bucket", "_place", "_row.r"),
        "external-shuffle",
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = shuffled.groupBy("_bucket").agg(F.count("*").alias("_n")).select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    placed = shuffled.join(F.broadcast(starts), "_bucket")
    return placed.select("r.*", (F.col("_start") + F.col("_place")).alias("position"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Add law (`rows`), shard (from 0) and slot (the row's place in its shard, gapless from 0)."""
    return shielded(docs, ["text"], lambda d, _: _dealt(d, shards, seed, bucket_bytes))


def _dealt(base: DataFrame, shards: int, seed: int, bucket_bytes: int) -> DataFrame:
    shuffled = external_shuffle(base, seed, bucket_bytes)
    rows = base.count()
    each, more = divmod(rows, shards)
    cut, size = more * (each + 1), max(each, 1)
    early = F.col("position") < cut
    return shuffled.select(
        *base.columns,
        F.lit("rows").alias("law"),
        F.when(early, F.expr(f"position div {each + 1}")).otherwise(F.expr(f"{more} + (position - {cut}) div {size}")).cast("int").alias("shard"),
        F.when(early, F.expr(f"position % {each + 1}")).otherwise(F.expr(f"(position - {cut}) % {size}")).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard; several tasks share a large shard, each with a run of consecutive slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
