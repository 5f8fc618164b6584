"""Centroid clustering against plain k-means, quality rules against plain counting."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality_rules
from ledgerloom.llm.orchard import Centroids, cluster_vectors
from ledgerloom.llm.quality_rules import MEASURES, STOP_WORDS, quality


def plain_clusters(rows, k, rounds, width, scale):
    """(id, cluster, distance) of every sound vector by measuring all distances."""
    sound = [
        (i, [math.floor(scale * x) for x in v]) for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(sound, key=mark)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for turn in range(rounds + 1):
        found = [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in sound]
        if turn < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, c) in zip(sound, found) if c == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    total, of = sum(d for d, _ in found), Counter()
    for d, c in found:
        of[c] += d
    return sorted((str(i), c, d, of[c], total, tuple(centroids[c])) for (i, _), (d, c) in zip(sound, found))


def vectors(kind, rng):
    if kind == "ties":
        return [(i, [rng.randrange(-1, 2) / 4 for _ in range(4)]) for i in range(300)]
    if kind == "clusters":
        centres = [[rng.gauss(0, 3) for _ in range(4)] for _ in range(12)]
        return [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(400)]
    if kind == "equal":
        return [(i % 7, [0.5, 0.25, -1.0, 2.0]) for i in range(60)]
    if kind == "few":
        return [(i, [float(i)] * 4) for i in range(5)]
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    return rows + [(500, None), (501, []), (502, [1.0, 2.0]), (503, [1.0, None, 0.0, 0.0]), (504, [float("nan"), 0.0, 0.0, 0.0]),
                   (505, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1, 0.2, 0.3, 0.4]), (3, [9.0, 9.0, 9.0, 9.0])]


@pytest.mark.parametrize("kind", ["ties", "clusters", "equal", "few", "broken"])
def test_clusters_against_plain_k_means(spark, kind):
    rows = vectors(kind, random.Random(kind))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = cluster_vectors(df, k=8, rounds=3, width=4).collect()
    found = sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in got)
    assert found == plain_clusters(rows, 8, 3, 4, 64)


def test_no_vectors_and_columns_of_the_caller(spark):
    rows = [(1, [0.0, 1.0], "a", {"k": 1}), (2, [5.0, 5.0], "b", None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, Cluster string, x map<string, int>")
    got = {r["vec_id"]: r for r in cluster_vectors(df, k=2, width=2).collect()}
    assert got[1]["x"] == {"k": 1} and got[2]["x"] is None and {got[1]["cluster"], got[2]["cluster"]} == {0, 1}
    empty = cluster_vectors(df.limit(0), k=2, width=2)
    assert empty.columns == ["vec_id", "embedding", "x", "cluster", "distance", "cluster_inertia", "inertia", "centroid"] and not empty.collect()


def test_the_search_finds_the_nearest_with_fewer_distances():
    rng = np.random.default_rng(4)
    points = rng.integers(-2000, 2000, (40, 6))
    x = points[rng.integers(0, 40, 3000)] + rng.integers(-40, 40, (3000, 6))
    centroid, distance, measured = Centroids(points).nearest(x)
    every = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (centroid == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < every.size / 3


def test_equal_centroids_and_ties_go_to_the_smaller_number():
    points = np.array([[4, 0], [0, 0], [0, 0], [2, 2], [2, -2]])
    x = np.array([[2, 0], [0, 0], [1, 1], [3, 1], [2, 2]])
    centroid, distance, _ = Centroids(points).nearest(x)
    assert centroid.tolist() == [0, 1, 1, 0, 3] and distance.tolist() == [4, 0, 2, 2, 0]


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_stop_words": sum(w.lower() in STOP_WORDS for w in words), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_cut_lines": sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0d]*$", x)) for x in lines),
        "n_bullet_lines": sum(bool(re.match(r"[\x20\x09-\x0d]*[-*•]", x)) for x in lines), "n_repeat_words": len(repeated),
    }


def sample_texts():
    rng = random.Random(12)
    texts = [None, "", " \t\n", "one", "a b c d e f g h", "x " * 40, "𝒳é… the…\n- the ...\n- the ...\n\n* of #", "\x0b\x0c\r\nw\r\nw\rw"]
    for _ in range(60):
        vocabulary = rng.choice([2, 3, 40, 400])
        words = [rng.choice(["the", "of", "a|b", "$5", "é", "w"]) + str(rng.randrange(vocabulary)) for _ in range(rng.randrange(1, 90))]
        if rng.random() < 0.4:
            words += words[: rng.randrange(5, 40)]
        texts.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t", " the ", "...\n"]) for w in words))
    passage = " ".join(f"p{i}" for i in range(30))
    texts.append(" ".join(f"w{i} {passage if i % 5000 == 0 else ''}" for i in range(60000)))
    return texts + [texts[5]]


def test_measures_against_plain_counting(spark):
    texts = sample_texts()
    got = quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for row in got:
        assert {m: row[m] for m in MEASURES} == plain_measures(texts[row["doc_id"]]), row["doc_id"]


def test_hashes_decide_nothing(spark, monkeypatch):
    """With one hash for all words every window is a candidate, and only the words tell them apart."""
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    texts = [" ".join(f"w{i % n}" for i in range(40)) for n in (3, 17, 32, 33, 34, 100)]
    got = quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["n_repeat_words"] for r in sorted(got)] == [plain_measures(t)["n_repeat_words"] for t in texts]


def test_verdicts(spark):
    prose = " ".join(f"the w{i} of x{i}" for i in range(30))
    cases = {
        "good": (prose, []), "null": (None, ["few_words"]), "short": ("the words", ["few_words"]),
        "again": (" ".join(["the", "same", "words", "of", "this", "line", "come", "back", "and", "back"] * 5), ["repeated_words"]),
        "symbols": (" ".join(f"the {i} |" for i in range(30)), ["word_length", "symbols"]), "odd": (" ".join(f"wort{i}" for i in range(30)), ["stop_words"]),
        "long": (" ".join(f"the {'x' * 60}{i}" for i in range(30)), ["word_length"]),
        "lines": (prose + "\nthe end\nthe end\nthe end", ["equal_lines"]),
    }
    rows = [(k, t, {"m": 1}, "mine") for k, (t, _) in cases.items()]
    df = spark.createDataFrame(rows, "key string, text string, measured map<string, int>, Failed string")
    got = {r["key"]: r for r in quality(df).collect()}
    assert {k: r["failed"] for k, r in got.items()} == {k: f for k, (_, f) in cases.items()}
    for key, row in got.items():
        assert row["kept"] == (not row["failed"]) and row["base_failed"] == bool({"few_words", "repeated_words"} & set(row["failed"]))
        assert row["measured"] == {"m": 1}
    assert quality(df.limit(0)).collect() == []


def test_one_projection(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = quality(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and "Generate" not in plan


@pytest.mark.parametrize("least, most, value, ok", [(3, None, 2, False), (3, None, 3, True), (None, 30, 30, True), (None, 30, 31, False)])
def test_bounds_are_inclusive(spark, least, most, value, ok):
    rule = quality_rules.Rule("r", "m", "base", least, most)
    row = spark.createDataFrame([((value, 100),)], "s struct<m: long, base: long>").select(quality_rules.holds(rule, F.col("s")).alias("ok")).first()
    assert row["ok"] == ok
