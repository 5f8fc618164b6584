"""Cleaning: flags on rows (rows are never deleted), name normalisation, sampling."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.fixed_values import EXTREME_MIN_ROWS, EXTREME_SIGMAS, SAMPLE_SEED
from ledgerloom.functions.dates import as_moment
from ledgerloom.functions.text import IS_ASCII, collapse_spaces, title_case_ascii, unicode_name, unicode_title
from ledgerloom.ledger import require
from ledgerloom.operators.periods import tenant_stats
from ledgerloom.plans.joins import BROADCAST_BYTES, BROADCAST_ROWS, WINDOW_ROWS, lookup_join, measured, pinned
from ledgerloom.plans.shared import SMALL_FILES, staged

FLAGS = ("flag_future_date", "flag_negative_amount", "flag_extreme_amount", "flag_duplicate")
DUPLICATE_KEY = ("date", "customer", "product", "amount")
# Rows are counted in so many buckets of digests to find keys with too many rows for one task.
KEY_BUCKETS = 1 << 16


def flag_future(ledger: DataFrame, as_of) -> DataFrame:
    return ledger.withColumn("flag_future_date", F.coalesce(F.col("date") > as_moment(as_of), F.lit(False)))


def flag_negative(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("flag_negative_amount", F.coalesce(F.col("amount") < 0, F.lit(False)))


def flag_extreme(ledger: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Amounts further from zero than the tenant's mean plus three sample standard deviations."""
    stats = tenant_stats(ledger) if stats is None else stats
    limit = F.col("mean_amount") + EXTREME_SIGMAS * F.col("std_amount")
    limits = stats.select(
        "tenant", F.when((F.col("n_rows") >= EXTREME_MIN_ROWS) & (F.col("std_amount") > 0), limit).alias("_limit")
    )
    value = F.abs(F.coalesce(F.col("amount").cast("double"), F.lit(0.0)))
    return (
        lookup_join(ledger, limits, ["tenant"], spread_by=["row_id"])
        .withColumn("flag_extreme_amount", F.coalesce(value > F.col("_limit"), F.lit(False)))
        .drop("_limit")
    )


def flag_duplicates(
    ledger: DataFrame, key: tuple[str, ...] = DUPLICATE_KEY, broadcast_rows: int = BROADCAST_ROWS, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """All but the first row of every set of rows that agree on `key` within a tenant; nulls are equal.

    Two 64-bit digests of the key are counted, so what is shuffled does not depend on how long names are. Where few digests repeat, their
    rows bring the keys to a second count, which decides, and the firsts of the repeated keys are broadcast: no row moves. Where
    many do, every row moves once, to the rows of its key; nothing is copied. Only keys in buckets of digests with more than
    `window_rows` rows, so every key of that many, are left to counts that combine ahead of their shuffles. So no task
    holds a larger set of copies, and one set may be any share of the ledger.
    """
    digest = ["_digest", "_second"]
    rows = ledger.withColumns({"_digest": F.xxhash64("tenant", *key), "_second": F.xxhash64(F.lit("second"), "tenant", *key)})
    repeated = staged(rows.groupBy(*digest).agg(F.count("*").alias("_n")).filter("_n > 1").select(*digest), "repeated-keys", options=SMALL_FILES)
    n, size = measured(repeated)
    if n <= broadcast_rows and size <= BROADCAST_BYTES:
        firsts = _firsts(rows.join(F.broadcast(repeated), digest), digest, key)
        n, size = measured(firsts)
        if n <= broadcast_rows and size <= BROADCAST_BYTES:
            return _later_than_broadcast(rows, firsts, digest, key).select(*ledger.columns, "flag_duplicate")
        firsts.unpersist()
    bucket = F.pmod("_digest", F.lit(KEY_BUCKETS))
    crowded = [r["bucket"] for r in rows.groupBy(bucket.alias("bucket")).count().filter(F.col("count") > window_rows).collect()]
    first = F.min("row_id").over(Window.partitionBy("tenant", *key))
    later = F.col("tenant").isNotNull() & F.coalesce(F.col("row_id") > first, F.lit(False))
    flagged = rows.filter(~bucket.isin(crowded)).withColumn("flag_duplicate", later).select(*ledger.columns, "flag_duplicate")
    if crowded:
        hot = rows.filter(bucket.isin(crowded))
        flagged = flagged.unionByName(_later_in_crowds(hot, digest, key, broadcast_rows).select(*ledger.columns, "flag_duplicate"))
    return flagged


def _firsts(rows: DataFrame, digest: list[str], key: tuple[str, ...]) -> DataFrame:
    """The lowest row_id of every key that repeats, below names that no row has."""
    first = rows.groupBy("tenant", *digest, *key).agg(F.min("row_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return pinned(first.select(*[F.col(c).alias(f"{c}_") for c in first.columns]))


def _same_key(key: tuple[str, ...]) -> Column:
    same = F.col("tenant") == F.col("tenant_")
    for column in key:
        same = same & F.col(column).eqNullSafe(F.col(f"{column}_"))
    return same


def _later_than_broadcast(rows: DataFrame, firsts: DataFrame, digest: list[str], key: tuple[str, ...]) -> DataFrame:
    same = _same_key(key)
    for column in digest:
        same = same & (F.col(column) == F.col(f"{column}_"))
    return rows.join(F.broadcast(firsts), same, "left").withColumn("flag_duplicate", F.coalesce(F.col("row_id") > F.col("first_"), F.lit(False)))


def _later_in_crowds(rows: DataFrame, digest: list[str], key: tuple[str, ...], broadcast_rows: int) -> DataFrame:
    """Flags by firsts that are broadcast if they were measured and found small; else rows that are not first find themselves
    by their unique row_id."""
    firsts = _firsts(rows, digest, key)
    n, size = measured(firsts)
    if n <= broadcast_rows and size <= BROADCAST_BYTES:
        return _later_than_broadcast(rows, firsts, digest, key)
    known = firsts.withColumnsRenamed({f"{d}_": d for d in digest})
    met = lookup_join(rows.select("tenant", *digest, *key, "row_id"), known, digest, spread_by=["row_id"], broadcast_rows=broadcast_rows, right_rows=n)
    later = met.filter(_same_key(key) & (F.col("row_id") > F.col("first_"))).select("tenant", *digest, "row_id").distinct()
    joined = rows.join(later.withColumn("_later", F.lit(True)), ["tenant", *digest, "row_id"], "left")
    return joined.withColumn("flag_duplicate", F.col("_later").isNotNull())


def _unicode_names(ledger: DataFrame) -> DataFrame:
    """Distinct non-ASCII names of both columns with their normal form: the only names that need Python."""
    both = F.array(*[
        F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in ("customer", "product")
    ])
    names = ledger.select(F.inline(both)).filter(~F.col("name").rlike(IS_ASCII)).distinct()
    clean = F.when(F.col("kind") == "customer", unicode_title("name")).otherwise(unicode_name("name"))
    return names.withColumn("_clean", clean)


def _odd(column: str) -> Column:
    """A name with other characters than ASCII, else null."""
    return F.when(~F.col(column).rlike(IS_ASCII), F.col(column))


def _unicode_size(ledger: DataFrame) -> tuple[int, int]:
    """About how many different non-ASCII names there are in both columns, and their bytes, by sketches: no name moves."""
    names = ("customer", "product")
    counted = [f(_odd(c)).alias(f"{c}_{label}") for c in names for f, label in (
        (F.approx_count_distinct, "n"), (lambda name: F.avg(F.octet_length(name)), "bytes"))]
    found = ledger.agg(*counted).first()
    return sum(found[f"{c}_n"] for c in names), sum(found[f"{c}_n"] * int(found[f"{c}_bytes"] or 0) for c in names)


def normalise_names(ledger: DataFrame, names_from: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Unicode NFC, collapsed whitespace, and title case for customers; products keep their case.

    ASCII names are handled inside the JVM. Where the distinct names with other characters are few, they go through Arrow once
    each and are broadcast; else they go through Arrow row by row, where they stand, so that no name is shuffled. They are counted and
    collected from `names_from`, the plainest form of the same ledger at hand, so that the work done on `ledger` since then
    is not repeated for it.
    """
    source = ledger if names_from is None else names_from
    built_in = {"customer": title_case_ascii(collapse_spaces(F.col("customer"))),
                "product": collapse_spaces(F.col("product"))}
    found, size = _unicode_size(source)
    if found == 0:
        return ledger.withColumns(built_in)
    if found <= broadcast_rows and size <= BROADCAST_BYTES:
        mapping = pinned(_unicode_names(source))
        found, size = measured(mapping)
        if found <= broadcast_rows and size <= BROADCAST_BYTES:
            result = ledger
            for column, ascii_form in built_in.items():
                clean = mapping.filter(F.col("kind") == column).select(F.col("name").alias(column), "_clean")
                joined = result.join(F.broadcast(clean), column, "left")
                result = joined.withColumn(
                    column, F.when(F.col(column).rlike(IS_ASCII), ascii_form).otherwise(F.col("_clean"))
                ).drop("_clean")
            return result.select(*ledger.columns)
        mapping.unpersist()
    clean = {"customer": unicode_title(_odd("customer")), "product": unicode_name(_odd("product"))}
    return ledger.withColumns({c: F.when(F.col(c).rlike(IS_ASCII), built_in[c]).otherwise(clean[c]) for c in built_in})


def normalise(ledger: DataFrame, as_of) -> DataFrame:
    """Rows with a date, flagged and with clean names."""
    require(ledger, "tenant", "row_id", "date", "customer", "product", "amount")
    dated = ledger.filter(F.col("date").isNotNull())
    flagged = flag_duplicates(flag_extreme(flag_negative(flag_future(dated, as_of))))
    return normalise_names(flagged, names_from=dated)


def flag_summary(flagged: DataFrame) -> DataFrame:
    """Number of rows per flag and tenant."""
    return flagged.groupBy("tenant").agg(F.count("*").alias("n_rows"), *[F.count_if(f).alias(f) for f in FLAGS])


def sample_ledger(ledger: DataFrame, share: float, seed: int = SAMPLE_SEED) -> DataFrame:
    """The given share of every ledger, chosen row by row by a hash of the row and the seed; nothing is shuffled."""
    limit = format(int(share * 16**7), "07x")
    chosen = F.substring(F.md5(F.concat("row_id", F.lit(str(seed)))), 1, 7) < limit
    return ledger.filter(chosen) if share < 1 else ledger
