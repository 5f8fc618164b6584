"""Columns of the caller come back whole from every operator, whatever they are called; invalid UTF-8 ends no job."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.collocations import top_collocations
from ledgerloom.llm.common import held_out
from ledgerloom.llm.decontaminate import find_contamination
from ledgerloom.llm.language_id import detect_languages, train_language_model
from ledgerloom.llm.licenses import scan_licenses
from ledgerloom.llm.orchard import cluster_vectors
from ledgerloom.llm.quality_rules import quality
from ledgerloom.llm.sharding import external_shuffle, shard_rows
from ledgerloom.llm.simhash import near_duplicates
from ledgerloom.llm.substring import remove_repeated
from ledgerloom.llm.toxicity import score_toxicity

NAMES = ("_id", "_row", "_number", "ids", "counts", "_dir", "_ranges", "_print", "_chosen", "_th", "_starts", "_all", "_bucket", "measured",
         "learnt", "position", "chunk", "_caller_0_", "own line", "a.b")


@pytest.fixture(scope="module")
def docs(spark, prose):
    rows = [(i, prose(i % 9, 70)) for i in range(24)] + [(30, None), (None, "a b"), (31, "")]
    own = [F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *own, F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))


def near(docs, spark):
    return near_duplicates(docs)


def shards(docs, spark):
    return shard_rows(docs, 3, bucket_bytes=2000)


def mixed(docs, spark):
    return external_shuffle(docs.drop("position"), bucket_bytes=2000)


def cut(docs, spark):
    return remove_repeated(docs, 20)


def leaks(docs, spark):
    items = docs.filter("doc_id < 3").select(F.col("doc_id").alias("item_id"), "text")
    return find_contamination(docs, items, automaton_bytes=300)


def toxic(docs, spark):
    labels = docs.filter("doc_id < 20").select("doc_id", (F.col("doc_id") % 9 == 1).cast("int").alias("toxic"))
    return score_toxicity(docs, labels, ~held_out("doc_id") & (F.col("learnt") != "x"))


def licensed(docs, spark):
    return scan_licenses(docs.withColumn("path", F.concat(F.lit("a/b/f"), F.col("doc_id").cast("string"))))


def languages(docs, spark):
    return detect_languages(docs, train_language_model(docs.withColumn("lang", F.lit("en"))))


def rules(docs, spark):
    return quality(docs)


def clusters(docs, spark):
    vectors = docs.withColumn("embedding", F.array(F.coalesce(F.length("text"), F.lit(0)).cast("float"), F.lit(1.0).cast("float")))
    return cluster_vectors(vectors, k=3, rounds=1, width=2, id_="doc_id")


OPERATORS = [near, shards, mixed, cut, leaks, toxic, licensed, languages, rules, clusters]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_callers_columns_come_back(spark, docs, operator):
    names = [n for n in NAMES if not (operator is mixed and n == "position")]
    rows = operator(docs, spark).collect()
    assert len(rows) == 27
    for row in rows:
        own = "-" if row["doc_id"] is None else str(row["doc_id"])
        assert all(row[n] == f"{n} {own}" for n in names) and row["m"] == {"k": row["doc_id"]}


@pytest.mark.parametrize("operator", [near, shards, cut, leaks, toxic, licensed, languages, rules], ids=lambda f: f.__name__)
def test_invalid_utf8_ends_no_job(spark, docs, operator):
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("20FF20C3"))).cast("string")
    assert len(operator(docs.withColumn("text", broken), spark).collect()) == 27


def test_invalid_utf8_in_phrases(spark):
    text = F.decode(F.encode(F.lit("a b "), "UTF-8"), "UTF-8")
    broken = F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("FFFE"))).cast("string")
    df = spark.range(3).select(broken.alias("text"), F.lit("en").alias("lang"))
    assert top_collocations(df, least=3, limit=5).count() == 1
