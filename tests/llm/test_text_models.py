import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language_id, licenses, toxicity
from ledgerloom.llm.common import held_out

SYLLABLES = {"aa": ["ka", "mo", "ri", "tu"], "bb": ["xel", "zor", "pim", "qua"], "cc": ["ößt", "ärg", "ünd", "ich"]}


def speech(lang, seed, words):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def language_model(spark):
    rows = [(i, speech(lang, i, 60), lang) for lang in SYLLABLES for i in range(40)] + [(900, None, "aa"), (901, "ka", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return language_id.train_language_model(df)


def test_languages_of_held_out_texts(spark, language_model):
    rows = [(1000 + i, speech(lang, 1000 + i, 3 + i), lang) for lang in SYLLABLES for i in range(40)]
    got = language_id.detect_languages(spark.createDataFrame(rows, "doc_id long, text string, truth string"), language_model)
    assert got.filter("lang_pred <> truth").count() == 0 and got.filter("score < 0.9").count() == 0


def test_mixtures_and_odd_texts(spark, language_model):
    half = speech("aa", 7, 100) + ". " + speech("bb", 8, 100)
    rows = [(1, half, 5), (2, None, 5), (3, "", 5), (4, "12 345 !?", 5), (5, speech("cc", 9, 30000), 5), (6, speech("cc", 3, 50).upper(), 5), (1, half, 5)]
    got = language_id.detect_languages(spark.createDataFrame(rows, "doc_id long, text string, score int"), language_model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "mixture"]
    by = {r["doc_id"]: r for r in got.collect()}
    shares = {m["lang"]: m["share"] for m in by[1]["mixture"]}
    assert set(shares) == {"aa", "bb"} and 0.3 < shares["aa"] < 0.7 and abs(sum(shares.values()) - 1) < 1e-6
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["mixture"] == [] for i in (2, 3, 4))
    assert by[5]["lang_pred"] == by[6]["lang_pred"] == "cc"


def test_language_model_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language_id.train_language_model(none)
    assert model.languages == [] and language_id.detect_languages(none, model).count() == 0
    some = spark.createDataFrame([(1, "abc", "aa")], "doc_id long, text string, lang string")
    assert language_id.detect_languages(some, model).first()["lang_pred"] == "und"


def test_held_out_by_crc(spark):
    got = spark.range(200).unionByName(spark.createDataFrame([(None,)], "id long")).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (r["id"] is not None and zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_contamination(text, items, window=10):
    words, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
    for item, body in items:
        w = WORD.findall((body or "").translate(LOWER))
        for k in range(max(len(w) - window, 0) + 1) if w else ():
            piece = w[k : k + window]
            for i in range(len(words) - len(piece) + 1):
                if words[i : i + len(piece)] == piece:
                    hit.update(range(i, i + len(piece)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def contamination_cases(prose):
    items = [("10", prose(1, 30)), ("9", prose(2, 12)), ("b", "Short answer"), ("c", "one"), ("d", ""), ("e", None), ("f", prose(1, 30)), ("g", "Ärger im Büro")]
    long = prose(1, 30)
    texts = [long, long.upper(), prose(3, 50) + ", " + "-".join(long.split()) + "! " + prose(4, 20), " ".join(long.split()[5:14]),
             " ".join(long.split()[5:15]), "a SHORT, answer short answer", None, "", "   ", "ones one-two", prose(2, 11), prose(2, 12) + prose(2, 12),
             "\x00ärger \x00Ärger im büro Büro", long + " " + long, " ".join([prose(9, 2000), long, prose(8, 2000)])]
    return items, texts


@pytest.mark.parametrize("limit", [decontaminate.AUTOMATON_BYTES, 200])
def test_contamination_against_plain_search(spark, prose, limit):
    items, texts = contamination_cases(prose)
    bench = spark.createDataFrame([*items, (None, prose(3, 20)), items[0]], "item_id string, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("items", F.lit("clash"))
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, bench, automaton_bytes=limit).collect()}
    for i, text in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == plain_contamination(text, items)
        covered = [w for s in got[i]["spans"] for w in WORD.findall(text[s["begin"] : s["end"]].translate(LOWER))]
        assert len(covered) == got[i]["n_hit"]
        assert all(text[s["begin"]].strip() and text[s["end"] - 1].strip() for s in got[i]["spans"])


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = decontaminate.find_contamination(docs, none).first()
    assert (row["n_words"], row["n_hit"], row["items"], row["spans"]) == (2, 0, [], [])
    assert decontaminate.find_contamination(docs.limit(0), none).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(5)
    idf = rng.uniform(1, 5, 40)
    made = []
    for d in range(300):
        ids = sorted(rng.choice(40, rng.integers(1, 8), replace=False).tolist())
        made.append(toxicity.Example(int(d * 7 % 300), int(d % 3 == 0), ids, rng.integers(1, 4, len(ids)).tolist()))
    made += [toxicity.Example(1000 + d, 1, made[5].ids, made[5].counts) for d in range(90)]
    index = toxicity.BlockMaxIndex(made, idf, block=16)

    def dense(ids, counts):
        v = np.zeros(40)
        v[ids] = toxicity.weigh(ids, counts, idf)
        return v

    table = np.array([dense(e.ids, e.counts) for e in index.examples])
    for e in made[::13]:
        cosine = np.round(table @ dense(e.ids, e.counts), 9)
        want = sorted((-s, n) for n, s in enumerate(cosine) if s > 0)[:10]
        got = index.nearest(e.ids, e.counts, 10)
        assert [n for _, n in got] == [n for _, n in want]
        assert np.allclose([s for s, _ in got], [-s for s, _ in want])


def test_toxic_texts_are_found_and_clean_ones_left(spark, prose):
    rng = random.Random(6)
    bad = ["scumbag", "vilething", "ratface"]
    rows, marks = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = prose(3000 + i, 40).split()
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper())
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or i % 3 == 0:
            marks.append((i, int(toxic)))
    rows += [(700, None), (701, ""), (702, "ratface " * 5000), (None, prose(9, 20)), (703, prose(9, 20)), (703, prose(9, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"toxic": F.lit("x"), "score": F.lit("clash")})
    labels = spark.createDataFrame([*marks, (0, 0), (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels, ~held_out("doc_id")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["score"] >= 0.3) == (i % 6 == 0) for i in range(600))
    assert by[702]["score"] > 0.5 and by[700]["score"] == by[701]["score"] < 0.1
    learnt = {i for i, _ in marks if zlib.crc32(str(i).encode()) % 4 != 2}
    assert by[6]["evidence"] and all(e["doc_id"] in learnt for r in got for e in r["evidence"])


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score_toxicity(docs, labels, ~held_out("doc_id")).collect()] == [0.0, 0.0]
    assert toxicity.score_toxicity(docs.limit(0), labels, ~held_out("doc_id")).count() == 0


def test_licences_and_inheritance(spark, prose):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("a/LICENSE", mit + "\n" + prose(1, 30)), ("a/x.py", prose(2, 20)), ("a/b/y.py", prose(3, 20)), ("a/b/c/COPYING.txt", gpl),
        ("a/b/c/z.py", prose(4, 10)), ("a/b/c/own.py", prose(5, 10) + "\n" + mit + "\n"), ("d/only.txt", gpl + "\n\n" + gpl), ("d/w.py", ""),
        ("e/w.py", None), ("e/f/v.py", prose(6, 20)), (None, prose(7, 9)), ("top.py", prose(8, 9)), ("ab/q.py", "the of and under license"), ("a/x.py", prose(2, 20)),
    ] + [(f"big/{i}", prose(100 + i, 20)) for i in range(60)] + [("big/LICENSE", "Licensed under the Apache License, Version 2.0")]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("clash"))
    rows = licenses.scan_licenses(files).collect()
    assert len(rows) == 75
    got = {r["path"]: (r["license"], r["license_from"]) for r in rows}
    assert got["a/LICENSE"] == ("MIT", "own") and got["a/x.py"] == got["a/b/y.py"] == ("MIT", "a")
    assert got["a/b/c/z.py"] == ("GPL-3.0", "a/b/c") and got["a/b/c/own.py"] == ("MIT", "own") and got["d/w.py"] == ("GPL-3.0", "d")
    assert got["e/w.py"] == got["e/f/v.py"] == got[None] == got["top.py"] == got["ab/q.py"] == (None, None)
    assert all(got[f"big/{i}"] == ("Apache-2.0", "big") for i in range(60))
    assert licenses.scan_licenses(files.limit(0)).count() == 0


def test_licences_of_many_files_and_of_few(spark, prose):
    mit = "Released under the MIT License"
    rows = [(f"d{i}/x.py", prose(i, 20) + ("\n" + mit if i % 3 == 0 else "")) for i in range(60)] + [("e/LICENSE", mit), ("e/w.py", prose(99, 20))]
    got = {r["path"]: (r["own_license"], r["license"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert all(got[f"d{i}/x.py"] == (("MIT", "MIT") if i % 3 == 0 else (None, None)) for i in range(60)) and got["e/w.py"] == (None, "MIT")
    few = licenses.scan_licenses(spark.createDataFrame(rows[-2:], "path string, text string")).collect()
    assert {r["path"]: r["license"] for r in few} == {"e/LICENSE": "MIT", "e/w.py": "MIT"}


def test_no_line_is_left_that_reaches_the_threshold():
    rng = random.Random(4)
    vocabulary = sorted({w for t in licenses.TEMPLATES.values() for w in licenses.words(t.encode())})
    matcher = licenses.Matcher(licenses.TEMPLATES, {w: rng.randrange(1000) for w in vocabulary}, 1000, 0.0)
    for _ in range(2000):
        line = rng.choices([*vocabulary, b"plain", b"word"], k=rng.randrange(1, 12))
        assert matcher.match(b" ".join(line))[1] <= matcher.bound(line) + 1e-8


def test_licence_cosine_is_plain_tf_idf():
    frequency = {w: n for n, w in enumerate(sorted({w for t in licenses.TEMPLATES.values() for w in licenses.words(t.encode())}))}
    matcher = licenses.Matcher(licenses.TEMPLATES, frequency, 100, 0.5)
    for name, text in licenses.TEMPLATES.items():
        found, cosine = matcher.match(text.upper().encode())
        assert found == name and cosine == pytest.approx(1)
    assert matcher.match(b"nothing of the kind") == (None, 0.0)
