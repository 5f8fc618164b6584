"""The stages one after the other against plain versions of their decisions, on a small corpus."""

import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import plain_components, plain_fingerprint, plain_removed
from test_text_models import plain_contamination, speech
from tokenizers import Tokenizer

from ledgerloom.plans.shared import staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    item, passage = speech("aa", "item", 24), speech("bb", "passage", 60)
    texts = [(i, speech(lang, i, 20 + 3 * i), lang) for i in range(40) for lang in ("aa", "bb", "cc")]
    rows = [(n, t, lang) for n, (_, t, lang) in enumerate(texts)]
    rows += [(500 + k, rows[5 + k][1], rows[5 + k][2]) for k in range(6)]
    rows += [(600 + k, rows[80 + k][1] + " " + passage + " " + speech("bb", 900 + k, 30), "bb") for k in range(5)]
    rows += [(700 + k, rows[60 + k][1] + " " + item + " " + speech("aa", 800 + k, 9), "aa") for k in range(4)]
    rows += [(800, None, "aa"), (801, "", "aa"), (802, "12 !", None), (803, speech("cc", 5, 4000), None), (90, rows[90][1], rows[90][2]), (None, speech("aa", 4, 30), "aa")]
    rng.shuffle(rows)
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "never met here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_every_stage_against_its_plain_version(spark, corpus):
    folder, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5
    names = docs.columns

    languages = staged(stages[0](spark, docs, folder), "t")
    assert languages.columns == names
    assert pairs(languages) == sorted(((d, t) for d, t in pairs(docs) if re.search(r"[^\W\d_]", t or "")), key=str)
    assert languages.filter("doc_id = 803 AND lang = 'cc'").count() == 1

    single = staged(stages[1](spark, languages, folder), "t")
    rows = pairs(languages)
    roots = plain_components([plain_fingerprint(t) for _, t in rows], 4)
    groups = {}
    for (d, t), root in zip(rows, roots):
        groups.setdefault(root, []).append((d if d is not None else 2**63, t))
    kept = pairs(single)
    assert single.columns == names and len(kept) == len(groups)
    assert {d if d is not None else 2**63 for d, _ in kept} == {min(g)[0] for g in groups.values()}

    cut = staged(stages[2](spark, single, folder), "t")
    plain = {d: (left, gone) for d, _, gone, left in plain_removed(kept, 50)}
    assert cut.columns == names and sum(gone for _, gone in plain.values()) > 0
    for r in cut.collect():
        left, gone = plain[r["doc_id"] if r["doc_id"] is not None else 2**63 - 1]
        assert r["text"].split() == left.split() and r["n_chars"] == len(r["text"])

    clean = staged(stages[3](spark, cut, folder), "t")
    want = [(d, t) for d, t in pairs(cut) if plain_contamination(t, [("1", item), ("2", "never met here")])[1] == 0]
    assert clean.columns == names and pairs(clean) == want and len(want) < len(pairs(cut))

    packed = stages[4](spark, clean, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {}
    for r in packed:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in want}
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= np.ceil(sum(fill.values()) / 2048) + 1


def test_extra_columns_stay_through_the_stages(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"score": F.lit("mine"), "_row": F.col("doc_id"), "n_hit": F.lit(3)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), "t")
        assert docs.columns[5:] == ["score", "_row", "n_hit"]
        assert docs.filter("score <> 'mine' OR NOT (_row <=> doc_id) OR n_hit <> 3").count() == 0


def test_empty_documents(spark, corpus):
    folder, _ = corpus
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_registered_queries_return_whole_tables(spark, corpus):
    import __spark_entry__

    named = __spark_entry__.queries()
    assert "pipeline" in named and [k for k in named if k.startswith("op")] and __spark_entry__.llm_sql is not None
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op1_language_id", "op10_toxicity"):
        assert named[name](spark, sf_dir).count() == docs
