"""Token counts: documents aggregated by encoded length, with suffix sums that answer for every context limit.

Defined results: a null text has length 0, like an empty one. Repeated rows count each. An empty table gives an empty
histogram, whose totals are 0 and whose quantiles are null. Very long texts are encoded whole. Extra columns are ignored.
"""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import annotate, shielded, texts_of
from ledgerloom.plans.shared import runs_in_tasks, staged

runs_in_tasks(__name__)

# Lengths whose running sums one task makes; sums of whole blocks are added to them.
BLOCK = 1024


def add_lengths(docs: DataFrame, ranks: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Add n_tokens under the byte-level vocabulary in the file `ranks`, whose words are split by `pattern`."""
    return shielded(docs, ["text"], lambda d, own: _measured(d, ranks, pattern, own), keep)


def _measured(docs: DataFrame, ranks: str, pattern: str, keep: list[str] | None) -> DataFrame:
    def encoder():
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    made: list = []

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        if not made:
            made.append(encoder())
        count = made[0].encode_ordinary
        return [pa.array([len(count(t.decode("utf-8", "replace"))) if t else 0 for t in texts_of(part)], pa.int64())]

    return annotate(docs, run, [T.StructField("n_tokens", T.LongType())], keep)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """A row per length met in n_tokens, with sums over the documents of at least and at most that length.

    `truncated_total` is what all documents hold together when each is cut to that length. Sums go by blocks of lengths:
    no task sees more than BLOCK lengths or the list of blocks.
    """
    by_length = staged(lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("docs")), "token-histogram")
    own = by_length.withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = own.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("length")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in "dt"],
        *[F.sum(c).over(everything).alias(f"all_{c}") for c in "dt"],
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length"))
    sums = own.join(blocks, "block").select(
        "length", "docs", "all_d", "all_t",
        (F.col("later_d") + F.sum("docs").over(inside)).alias("docs_at_least"),
        (F.col("later_t") + F.sum(F.col("docs") * F.col("length")).over(inside)).alias("tokens_at_least"),
    )
    over = F.col("docs_at_least") - F.col("docs")
    return sums.select(
        "length", "docs", "docs_at_least", "tokens_at_least",
        (F.col("all_d") - over).alias("docs_at_most"),
        (F.col("all_t") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut to `limit`, for any limit, from the suffix sums alone."""
    below = histogram.filter(F.col("length") <= limit).orderBy(F.desc("length")).limit(1).first()
    rest = histogram.filter(F.col("length") > limit).orderBy("length").limit(1).first()
    kept = 0 if below is None else below["truncated_total"] - below["length"] * (below["docs_at_least"] - below["docs"])
    return kept + (0 if rest is None else limit * rest["docs_at_least"])


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share `q` of the documents does not exceed."""
    docs = histogram.agg(F.sum("docs")).first()[0] or 0
    need = max(int(np.ceil(q * docs - 1e-9)), 1)
    return histogram.filter(F.col("docs_at_most") >= need).agg(F.min("length")).first()[0]
