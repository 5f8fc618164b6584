"""Corpus preparation: language ID, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage takes all that its predecessor kept. All but the last return the columns of documents. Nulls, empty and very
long texts, ties, repeated rows, empty tables and extra columns are handled as the operators' docstrings say.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import held_out, table
from ledgerloom.llm.decontaminate import find_contamination
from ledgerloom.llm.language_id import UNKNOWN, detect_languages, train_language_model
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.simhash import near_duplicates
from ledgerloom.llm.substring import remove_repeated
from ledgerloom.plans.shared import staged

# A document goes if not even this share of it is in one language.
MAIN_SHARE = 0.5

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply `work` to docs while extra columns bear names that no operator uses, and return the columns of docs."""
    away = {c: f"_extra_{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
    done = work(docs.withColumnsRenamed(away))
    return done.select(*[F.col(away.get(c, c)).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a main language go; `lang` becomes the language found."""
    model = train_language_model(docs.filter(~held_out("doc_id")))
    found = lambda d: detect_languages(d, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MAIN_SHARE))
    return shielded(docs, lambda d: found(d).withColumn("lang", F.col("lang_pred")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return shielded(docs, lambda d: near_duplicates(d).filter("representative"))


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start in an earlier document go from the text; a document stays even if nothing is left."""

    def cut(d: DataFrame) -> DataFrame:
        text = F.when(F.col("n_removed") > 0, F.col("_left")).otherwise(F.col("text"))
        return remove_repeated(d, result="_left").withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))

    return shielded(docs, cut)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    benchmark = table(spark, sf_dir, "benchmark")
    return shielded(docs, lambda d: find_contamination(d, benchmark).filter("n_hit = 0"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Letter statistics, XXH64 and the tokenizer are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
