"""Fuzzy product names: similar spellings within a tenant are found, clustered and replaced by one name."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.fixed_values import NAME_MIN_COUNT, NAME_SIMILARITY
from ledgerloom.plans.joins import SALTS, lookup_join, pinned
from ledgerloom.plans.shared import cut_lineage

# A shared anchor is refined further while it would pair up more rows than this.
CROWDED_PAIRS = 10_000
KEY = ["tenant", "_long", "_anchor"]


def name_counts(ledger: DataFrame, column: str = "product") -> DataFrame:
    return (
        ledger.filter(F.col(column).isNotNull())
        .groupBy("tenant", F.col(column).alias("name")).agg(F.count("*").alias("n"))
    )


def _edits(length: Column, threshold: int) -> Column:
    """Most edits two names may differ by, the longer one having `length` characters."""
    return F.floor(length * (100 - threshold) / 100).cast("int")


def _whole_names(names: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Every name in the role of the longer one and, per possible longer length, in the role of the shorter one.

    `_rest` is the part of the name that no anchor covers yet, `_rest_long` its length in the longer name, and `_edits`
    the most edits that part may take.
    """
    start = {"_anchor": F.lit(""), "_rest": F.col("name"), "_rest_long": F.col("_long"),
             "_edits": _edits(F.col("_long"), threshold)}
    size = F.length("name")
    longer = names.select("tenant", "name", "_label", size.alias("_long")).withColumns(start).filter("_edits >= 1")
    reach = F.floor(size * 100 / threshold).cast("int")
    shorter = (
        names.filter(size > 0).select("tenant", "name", "_label", F.explode(F.sequence(size, reach)).alias("_long"))
        .withColumns(start)
        .filter((F.col("_edits") >= 1) & (F.col("_long") - size <= F.col("_edits")))
    )
    return longer, shorter


def _anchored(rows: DataFrame, is_longer: bool) -> DataFrame:
    """Rows once for every piece of the open part that may be equal in both names; that piece joins the anchor.

    Cut the open part of the longer name into one piece more than it may take edits. Some piece is untouched, with at
    most as many edits before it as there are pieces before it, and the others after it. That bounds where the piece
    can lie in the shorter name, and what either side of it may still differ by. The longer side stays open.
    """
    pieces = F.col("_edits") + 1
    base, extra = F.floor(F.col("_rest_long") / pieces).cast("int"), F.col("_rest_long") % pieces
    cut = rows.withColumn("_no", F.explode(F.sequence(F.lit(0), F.col("_edits")))).withColumns({
        "_start": (F.col("_no") * base + F.least(F.col("_no"), extra)).cast("int"),
        "_size": (base + F.when(F.col("_no") < extra, 1).otherwise(0)).cast("int"),
    })
    if is_longer:
        placed = cut.withColumn("_at", F.col("_start"))
    else:
        gap = F.length("_rest") - F.col("_rest_long")
        after = F.col("_edits") - F.col("_no")
        low, high = F.greatest(-F.col("_no"), gap - after), F.least(F.col("_no"), gap + after)
        placed = (
            cut.withColumns({"_low": low, "_high": high}).filter(F.col("_low") <= F.col("_high"))
            .withColumn("_shift", F.explode(F.sequence(F.col("_low"), F.col("_high"))))
            .withColumn("_at", F.col("_start") + F.col("_shift"))
            .filter((F.col("_at") >= 0) & (F.col("_at") + F.col("_size") <= F.length("_rest")))
            .drop("_low", "_high", "_shift")
        )
    piece = F.substring("_rest", F.col("_at") + 1, F.col("_size"))
    before, behind = F.col("_start"), F.col("_rest_long") - F.col("_start") - F.col("_size")
    open_left = before > behind
    return placed.select(
        "tenant", "name", "_label", "_long",
        F.concat_ws("\u0001", "_anchor", F.col("_no").cast("string"), piece).alias("_anchor"),
        F.when(open_left, F.left("_rest", F.col("_at")))
        .otherwise(F.substring("_rest", F.col("_at") + F.col("_size") + 1, F.length("_rest"))).alias("_rest"),
        F.when(open_left, before).otherwise(behind).alias("_rest_long"),
        F.when(open_left, F.col("_no")).otherwise(F.col("_edits") - F.col("_no")).alias("_edits"),
    ).distinct()


def _pairs_on_anchor(longer: DataFrame, shorter: DataFrame, salts: int = 1) -> DataFrame:
    """Names that meet on an anchor; with several salts the pairs of one anchor are made by as many tasks."""
    salt = F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int")
    left = longer.select(*KEY, F.col("name").alias("long_name"), F.col("_label").alias("_long_label"), salt.alias("_salt"))
    right = shorter.select(
        *KEY, F.col("name").alias("short_name"), "_label", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    return left.join(right, [*KEY, "_salt"]).filter(F.col("_label") != F.col("_long_label")).filter(
        (F.length("short_name") < F.col("_long")) | (F.col("short_name") < F.col("long_name"))
    ).select("tenant", "_long", "long_name", "short_name")


def _anchor_sizes(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """Pairs each anchor would make, whether its open part can still be cut, and whether all its names are joined already."""
    labels = [F.min("_label").alias("_low"), F.max("_label").alias("_high")]
    long_side = longer.groupBy(*KEY).agg(
        F.count("*").alias("_n"), (F.min("_rest_long") > F.min("_edits")).alias("_can_cut"), *labels
    )
    short_side = shorter.groupBy(*KEY).agg(F.count("*").alias("_m"), *[c.alias(f"_short{i}") for i, c in enumerate(labels)])
    one = (F.col("_low") == F.col("_high")) & (F.col("_short0") == F.col("_low")) & (F.col("_short1") == F.col("_low"))
    return pinned(long_side.join(short_side, KEY).select(
        *KEY, F.when(one, 0).otherwise(F.col("_n") * F.col("_m")).alias("_pairs"), "_can_cut", one.alias("_settled")
    ))


def similar_pairs(
    names: DataFrame, threshold: int = NAME_SIMILARITY, crowded_pairs: int = CROWDED_PAIRS
) -> DataFrame:
    """All pairs of names of a tenant whose similarity 100·(1 − edits / longer length) reaches the threshold.

    Two such names share an anchor: a piece of text that the edits left alone. Names meet in an equi-join on it, which
    misses no pair, and the edit distance decides. An anchor that too many names share, such as a brand in front of
    every product, is not joined on: its rows are given a second anchor in the part still open, and so on, so a common
    word does not pair up all the names that hold it. Where a further anchor would not lower the number of pairs, the
    names really are alike and their pairs are made by many tasks.

    With a column `_label`, only pairs of different labels are returned, and anchors whose names all bear one label are
    left out before any pair is made.
    """
    if "_label" not in names.columns:
        names = names.withColumn("_label", F.col("name"))
    sides = _whole_names(names, threshold)
    candidates, before, before_pairs = None, None, 0
    while True:
        sides = tuple(cut_lineage(_anchored(side, is_longer)) for side, is_longer in zip(sides, (True, False)))
        sizes = _anchor_sizes(*sides)
        if before and (sizes.agg(F.sum("_pairs")).first()[0] or 0) >= before_pairs:
            candidates = candidates.unionByName(_pairs_on_anchor(*before, salts=SALTS))
            break
        crowd = F.col("_pairs") > crowded_pairs
        crowded, before_pairs, settled = sizes.agg(
            F.count_if(crowd & F.col("_can_cut")), F.sum(F.when(crowd & F.col("_can_cut"), F.col("_pairs"))), F.count_if("_settled")
        ).first()
        marks = sizes.filter(crowd & F.col("_can_cut") | F.col("_settled")).select(*KEY, (~F.col("_settled")).alias("_crowded"))
        marked = [lookup_join(s, marks, KEY, "left", spread_by=["name"], right_rows=crowded + settled) for s in sides]
        found = _pairs_on_anchor(*[side.filter(F.col("_crowded").isNull()) for side in marked])
        candidates = found if candidates is None else candidates.unionByName(found)
        if crowded == 0:
            break
        before = sides = tuple(pinned(side.filter("_crowded").drop("_crowded")) for side in marked)
    distance = F.expr(f"levenshtein(short_name, long_name, cast(floor(_long * {100 - threshold} / 100) as int))")
    return (
        candidates.distinct()
        .withColumn("edits", distance).filter(F.col("edits") >= 0)
        .select(
            "tenant", F.least("short_name", "long_name").alias("name_a"),
            F.greatest("short_name", "long_name").alias("name_b"),
            (100 * (1 - F.col("edits") / F.col("_long"))).alias("similarity"),
        )
    )


def sure_links(names: DataFrame, threshold: int = NAME_SIMILARITY) -> DataFrame:
    """Links (tenant, name_a, name_b) that need no check: names that are equal without one letter each are two edits apart.

    Every name is listed once per letter left out and linked to the smallest name of each list, so the links grow with
    the names and not with their pairs. Only names long enough to take two edits.
    """
    size = F.length("name")
    keyed = cut_lineage(
        names.filter(_edits(size, threshold) >= 2).withColumn("_at", F.explode(F.sequence(F.lit(1), size)))
        .select("tenant", "name", F.concat(F.left("name", F.col("_at") - 1), F.substring("name", F.col("_at") + 1, size)).alias("_key"))
    )
    lowest = keyed.groupBy("tenant", "_key").agg(F.min("name").alias("name_a"), F.max("name").alias("_last"))
    lowest = lowest.filter("name_a < _last").drop("_last")
    return keyed.join(lowest, ["tenant", "_key"]).filter("name_a < name").select(
        "tenant", "name_a", F.col("name").alias("name_b")
    ).distinct()


def connected_groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Transitive closure of the pairs: every node with the smallest name of its group as label.

    Each round takes the smallest label among a node and its neighbours, then jumps to the label of that label, so
    even long chains settle in few rounds. Lineage is cut in the shared folder after every round.
    """
    edges = cut_lineage(
        pairs.select("tenant", F.col("name_a").alias("name"), F.col("name_b").alias("other"))
        .unionByName(pairs.select("tenant", F.col("name_b").alias("name"), F.col("name_a").alias("other")))
    )
    labels = cut_lineage(nodes.select("tenant", "name", F.col("name").alias("label")))
    size = labels.count()
    while True:
        of_other = labels.select("tenant", F.col("name").alias("other"), F.col("label").alias("_near"))
        nearest = (
            lookup_join(edges, of_other, ["tenant", "other"], spread_by=["name"], right_rows=size)
            .groupBy("tenant", "name").agg(F.min("_near").alias("_near"))
        )
        lowered = pinned(
            labels.join(nearest, ["tenant", "name"], "left").withColumn("_low", F.least("label", "_near"))
        )
        jump = lowered.select("tenant", F.col("name").alias("_low"), F.col("_low").alias("_jump"))
        moved = cut_lineage(
            lookup_join(lowered, jump, ["tenant", "_low"], "left", spread_by=["name"], right_rows=size).select(
                "tenant", "name", F.least("_low", "_jump").alias("label"),
                (F.least("_low", "_jump") < F.col("label")).alias("_moved"),
            )
        )
        labels = moved.drop("_moved")
        if moved.filter("_moved").limit(1).count() == 0:
            return labels


def canonical_names(
    counts: DataFrame, threshold: int = NAME_SIMILARITY, min_count: int = NAME_MIN_COUNT
) -> DataFrame:
    """tenant, name, canonical: the longest name of each group, then the most frequent, then the first by alphabet.

    Names seen fewer than `min_count` times take no part.
    """
    names = cut_lineage(counts.filter(F.col("n") >= min_count))
    sure = cut_lineage(sure_links(names, threshold))
    joined = connected_groups(names, sure).withColumnRenamed("label", "_label")
    pairs = similar_pairs(names.join(joined, ["tenant", "name"]), threshold).select("tenant", "name_a", "name_b")
    groups = connected_groups(names, pairs.unionByName(sure))
    sized = cut_lineage(groups.join(names, ["tenant", "name"]))
    best = sized.groupBy("tenant", "label").agg(
        F.min_by("name", F.struct(-F.length("name"), -F.col("n"), F.col("name"))).alias("canonical")
    )
    return lookup_join(sized, best, ["tenant", "label"], spread_by=["name"]).select("tenant", "name", "canonical")


def merge_product_names(
    ledger: DataFrame, column: str = "product", threshold: int = NAME_SIMILARITY, min_count: int = NAME_MIN_COUNT
) -> tuple[DataFrame, DataFrame]:
    """The ledger with canonical product names, and the mapping used."""
    mapping = cut_lineage(canonical_names(name_counts(ledger, column), threshold, min_count))
    changed = mapping.filter(F.col("name") != F.col("canonical")).withColumnRenamed("name", column)
    merged = lookup_join(ledger, changed, ["tenant", column], "left", spread_by=["row_id"])
    return (
        merged.withColumn(column, F.coalesce("canonical", column)).select(*ledger.columns),
        mapping,
    )
