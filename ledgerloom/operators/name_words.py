"""Product names grouped by their words: order, spacing and case do not count, and a name inside another one is the same ware.

A name is seen as its bag: the words and numbers in it, sorted. Names with one bag are one node, so that no pairs are listed for
them. Bags are linked if all words of one are among those of the other, or if they are spelt alike. Grouping then goes on as for whole
names.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.fixed_values import NAME_MIN_COUNT, NAME_SIMILARITY
from ledgerloom.operators.product_names import connected_groups, name_counts, similar_pairs, sure_links
from ledgerloom.plans.joins import lookup_join
from ledgerloom.plans.shared import cut_lineage

# Numbers and runs of letters are words of their own, so that 1kg is 1 kg.
WORD = r"[0-9]+|[^\x00-\x60\x7B-\x7F]+"
# A name inside another one counts from so many words on, and if the other one has less than so many times its characters.
INNER_WORDS = 2
INNER_RATIO = 1.5


def bag(name: Column) -> Column:
    """The words of a name, sorted and joined by blanks; A-Z are lower-cased."""
    lower = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_join(F.sort_array(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))), " ")


def contained_links(bags: DataFrame, inner_words: int = INNER_WORDS, ratio: float = INNER_RATIO) -> DataFrame:
    """Links (tenant, name_a, name_b) of bags of which one holds all words of the other.

    The inner bag's rarest word must stand in the outer one. So an inner bag is listed once, below that word, and an outer one below each
    of its words: a word that many names share brings together only the few names that have none rarer.
    """
    words = bags.select("tenant", "name", F.array_distinct(F.split("name", " ")).alias("words"))
    spread = cut_lineage(words.withColumn("word", F.explode("words")))
    frequency = spread.groupBy("tenant", "word").agg(F.count("*").alias("n"))
    counted = lookup_join(spread, frequency, ["tenant", "word"], spread_by=["name"])
    inner = counted.filter(F.size("words") >= inner_words).groupBy("tenant", "name").agg(
        F.min_by("word", F.struct("n", "word")).alias("word"), F.any_value("words").alias("inner_words")
    )
    outer = spread.select("tenant", "word", F.col("name").alias("outer"), "words")
    met = inner.join(outer, ["tenant", "word"]).filter(
        (F.col("name") != F.col("outer")) & (F.length("outer") < F.length("name") * ratio)
        & (F.size(F.array_except("inner_words", "words")) == 0)
    )
    return met.select("tenant", F.least("name", "outer").alias("name_a"), F.greatest("name", "outer").alias("name_b")).distinct()


def canonical_by_words(
    counts: DataFrame, threshold: int = NAME_SIMILARITY, min_count: int = NAME_MIN_COUNT
) -> DataFrame:
    """tenant, name, canonical: the longest name of each group, then the most frequent, then the first by alphabet.

    Names seen fewer than `min_count` times, and names without a word, take no part.
    """
    names = cut_lineage(counts.filter(F.col("n") >= min_count).withColumn("bag", bag(F.col("name"))).filter("bag != ''"))
    bags = cut_lineage(names.select("tenant", F.col("bag").alias("name")).distinct())
    sure = cut_lineage(sure_links(bags, threshold).unionByName(contained_links(bags)))
    joined = connected_groups(bags, sure).withColumnRenamed("label", "_label")
    pairs = similar_pairs(bags.join(joined, ["tenant", "name"]), threshold).select("tenant", "name_a", "name_b")
    groups = connected_groups(bags, pairs.unionByName(sure)).withColumnRenamed("name", "bag")
    sized = cut_lineage(lookup_join(names, groups, ["tenant", "bag"], spread_by=["name"]))
    best = sized.groupBy("tenant", "label").agg(
        F.min_by("name", F.struct(-F.length("name"), -F.col("n"), F.col("name"))).alias("canonical")
    )
    return lookup_join(sized, best, ["tenant", "label"], spread_by=["name"]).select("tenant", "name", "canonical")


def merge_by_words(
    ledger: DataFrame, column: str = "product", threshold: int = NAME_SIMILARITY, min_count: int = NAME_MIN_COUNT
) -> tuple[DataFrame, DataFrame]:
    """The ledger with canonical product names, and the mapping used."""
    mapping = cut_lineage(canonical_by_words(name_counts(ledger, column), threshold, min_count))
    changed = mapping.filter(F.col("name") != F.col("canonical")).withColumnRenamed("name", column)
    merged = lookup_join(ledger, changed, ["tenant", column], "left", spread_by=["row_id"])
    return merged.withColumn(column, F.coalesce("canonical", column)).select(*ledger.columns), mapping
