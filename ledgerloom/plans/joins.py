"""Joins, top-k and ranking that hold up when one key owns a large share of the rows."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.shared import cut_lineage

# A lookup side is broadcast only when it was measured and has at most this many bytes, 16 per row and column included,
# and rows, beyond which building its hash table takes a driver too long.
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 500_000
# Copies of the lookup side, and so tasks per key of the other side, when it is too large to broadcast.
SALTS = 32
# A group is sorted inside one task only when its size was checked to be at most this.
WINDOW_ROWS = 1_000_000


_pinned: list[DataFrame] = []


def pinned(df: DataFrame) -> DataFrame:
    """Keep a small per-tenant table so that every operator which needs it shares one pass over the ledger."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _pinned.append(kept)
    return kept


@contextmanager
def releasing() -> Iterator[None]:
    """Let go of everything pinned inside the block; results that are still needed must be written there."""
    before = len(_pinned)
    try:
        yield
    finally:
        for df in _pinned[before:]:
            df.unpersist()
        del _pinned[before:]


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a table, counted: the text of every value and 16 bytes for each."""
    wide = [F.col(c) if "<" not in kind else F.to_json(F.struct(c)) for c, kind in df.dtypes]
    size = sum((F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) for c in wide), F.lit(16 * len(df.columns)))
    rows, total = df.agg(F.count("*"), F.sum(size.cast("long"))).first()
    return rows, total or 0


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    spread_by: list[str] | None = None,
    broadcast_rows: int | None = None,
    right_rows: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join `left` to `right`, which holds at most one row per key.

    The lookup side is pinned and measured, unless the caller knows that it has more than `broadcast_rows` as `right_rows`.
    Up to BROADCAST_BYTES and `broadcast_rows` it is broadcast, so `left` does not move. Beyond that both sides are shuffled on the key plus a salt taken from `spread_by`: the rows of one hot key then go to
    `salts` tasks, and because the salt is part of the partitioning no later aggregate reuses a per-key layout. Where no key can
    have many rows in `left`, one salt will do. Spark is told not to broadcast the copies, for it takes them to be as small as what they are copies of.
    """
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    right_bytes = 0
    if right_rows is None or right_rows <= limit:
        right = pinned(right) if right_rows is None else right
        right_rows, right_bytes = measured(right)
    if right_rows <= limit and right_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    if salts == 1:
        return left.join(right.hint("merge"), on, how)
    spread = spread_by or [c for c in left.columns if c not in on] or on
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first `n` rows of every group, numbered.

    Spark turns the filtered row_number into a group limit ahead of the shuffle, so a task forwards at most `n` rows
    per group however large the group is.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def rank_in_group(
    df: DataFrame,
    group: list[str],
    order: list[str],
    rank: str,
    window_rows: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Exact row number within each group; `order` must be unique inside a group.

    When every group has at most `window_rows` rows a plain window does it. Otherwise the rows are range-partitioned on
    (group, order) into slices of even size, numbered inside their slice, and shifted by the size of the group's
    earlier slices, so no group is ever collected into one task. `largest` is the size of the largest group where the
    caller has counted already.
    """
    limit = WINDOW_ROWS if window_rows is None else window_rows
    if largest is None:
        largest = df.groupBy(*group).count().agg(F.max("count").alias("n")).first()["n"] or 0
    if largest <= limit:
        window = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(rank, F.row_number().over(window).cast("long"))
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Checkpointed so that slice numbers are data from here on and cannot change when a task is run again.
    sliced = cut_lineage(
        df.repartitionByRange(slices, *group, *order).withColumn("_slice", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    local = Window.partitionBy(*group, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_local", F.row_number().over(local))
    return (
        numbered.join(offsets, [*group, "_slice"])
        .withColumn(rank, F.col("_local") + F.col("_before"))
        .drop("_local", "_before", "_slice")
    )
