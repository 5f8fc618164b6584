"""The registered query of every operator of this subpackage, over whole tables and with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.collocations import top_collocations
from ledgerloom.llm.common import held_out, table
from ledgerloom.llm.cover_search import top_products
from ledgerloom.llm.decontaminate import find_contamination
from ledgerloom.llm.language_id import detect_languages, train_language_model
from ledgerloom.llm.licenses import scan_licenses
from ledgerloom.llm.orchard import cluster_vectors
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.quality_rules import quality
from ledgerloom.llm.sharding import shard_rows
from ledgerloom.llm.simhash import near_duplicates
from ledgerloom.llm.substring import remove_repeated
from ledgerloom.llm.token_counts import add_lengths, length_histogram
from ledgerloom.llm.toxicity import score_toxicity


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_language_model(docs.filter(~held_out("doc_id")))
    found = detect_languages(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated(docs, keep=["doc_id"]).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_rows(table(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"),
        "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, keep=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, thousands of ids and, for odd ids, hundreds. A document that opens with a licence
    statement speaks for its directory."""
    step = lambda mark, size: F.concat(F.lit(mark), F.floor(F.col("doc_id") / size).cast("string"))
    below = F.when(F.col("doc_id") % 2 == 1, step("h", 100))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), step("k", 1000), below, step("doc", 1))
    files = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    scanned = scan_licenses(files, keep=["doc_id"], speaks=F.col("own_line") == 0)
    return scanned.select("doc_id", "path", "own_license", F.round("similarity", 6).alias("similarity"), "own_line", "license", "license_from")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return length_histogram(add_lengths(docs, ranks, public_tokenizers.PATTERN, keep=[]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out("doc_id"), keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = cluster_vectors(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_stop_words", "n_lines", "n_cut_lines", "n_bullet_lines", F.array_join("failed", ",").alias("failed"),
    )


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_cover_tree_search": op3_cover_tree_search,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_licenses": op7_licenses,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_quality_rules": op12_quality_rules,
    "op13_phrase_collocations": op13_phrase_collocations,
}
