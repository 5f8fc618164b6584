import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash, substring
from ledgerloom.llm.common import SLICE_BYTES, components

SPACE = r"[^\x20\x09-\x0D]+"


def plain_removed(docs, window):
    """id -> words left, by comparing all windows."""
    firsts = {}
    words = [(d if d is not None else 2**63 - 1, re.findall(SPACE, t or "")) for d, t in docs]
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            firsts[key] = min(d, firsts.get(key, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if firsts[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def planted(prose):
    passage, long = prose(1, 70), prose(2, 400)
    docs = [(i, prose(100 + i, 40 + i)) for i in range(30)]
    docs += [(40, passage), (41, "a b " + passage + " c"), (42, prose(5, 60) + "\n" + passage + "\t" + prose(6, 60)), (43, passage)]
    docs += [(50, long), (51, long), (52, long.replace("w7x", "other", 1)), (53, long[: len(long) // 2])]
    docs += [(60, None), (61, ""), (62, " \t\n"), (63, "word " * 120), (64, "word " * 90), (65, "word " * 49)]
    docs += [(None, passage), (41, passage), (50, long), (70, prose(7, 49)), (71, prose(7, 49)), (72, prose(8, 50)), (73, prose(8, 51))]
    docs += [(80, "é" * 60 + " " + passage), (81, "x" * 5000 + " " + passage)]
    return docs


def test_repeated_passages_against_all_windows(spark, prose):
    docs = planted(prose)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_words": F.lit("kept away"), "source": F.lit("s")})
    got = substring.remove_repeated(df)
    assert got.columns == ["doc_id", "text", "source", "n_words", "n_removed", "kept_text"]
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else 2**63 - 1, r["n_words"], r["n_removed"], r["kept_text"] or "") for r in got.collect()), key=str)
    assert rows == plain_removed(docs, 50)
    assert {r["doc_id"] for r in got.filter("kept_text IS NULL").collect()} == {60}


@pytest.mark.parametrize("words", range(17))
def test_slices_of_few_words(words):
    text = " ".join(f"v{i}" for i in range(words)).encode()
    assert len(substring.anchors(substring.Words([text, None]), substring.levels(50)[0], 50)) == 0


def test_short_texts_alone_and_between_long_ones(spark, prose):
    short = [(1, prose(1, 5))]
    long = " ".join(f"u{i}" for i in range(700_000))
    assert len(long) > SLICE_BYTES
    between = [(1, long), (2, prose(2, 5)), (3, long)]
    for rows in (short, between):
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.remove_repeated(docs, keep=["doc_id"]).collect()}
        assert got == {i: (len(t.split()), len(t.split()) if i == 3 else 0) for i, t in rows}


def test_other_windows_and_order_of_ids(spark, prose):
    rng = random.Random(3)
    pool = [prose(900 + i, 12, 40) for i in range(12)]
    docs = [(rng.randrange(10**6), " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for _ in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for window in (8, 13):
        got = substring.remove_repeated(df, window=window, keep=["doc_id"])
        assert sorted(((r[0], r[1], r[2], r[3]) for r in got.collect()), key=str) == plain_removed(docs, window)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeated(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_anchors_meet_in_equal_windows(prose):
    shared = prose(11, 50)
    found = []
    for before in (0, 3, 41):
        words = substring.Words([(prose(20 + before, before) + " " + shared + " " + prose(30 + before, 30)).encode()])
        at = substring.anchors(words, 13, 50)
        inside = at[(at >= before) & (at + 13 <= before + 50)] - before
        low = words.windows(13)
        found.append({int(low[before + a]) for a in inside})
    assert set.intersection(*found)


def plain_fingerprint(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(SPACE, (text or "").translate(lower))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_fingerprints_and_groups_against_all_pairs(spark, prose):
    base = prose(50, 300)
    docs = [(i, prose(200 + i, 5 + 3 * i)) for i in range(60)] + [(100 + i, base.replace(f"w{i}x", "NEW", 1)) for i in range(60)]
    docs += [(200 + i, base) for i in range(40)] + [(300, None), (301, ""), (302, "  "), (303, "One two"), (304, "one TWO"), (None, base), (5, prose(205, 20))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).withColumn("extra", F.lit(1))
    got = simhash.near_duplicates(df)
    assert set(got.columns) == {"doc_id", "text", "extra", "fingerprint", "component_id", "representative"}
    rows = got.collect()
    prints = [plain_fingerprint(t) for _, t in docs]
    roots = plain_components(prints, 4)
    low = {}
    for (d, _), r in zip(docs, roots):
        low[r] = min(low.get(r, 2**63), d if d is not None else 2**63)
    expected = sorted((str(d), f"{p:016x}", low[r]) for (d, _), p, r in zip(docs, prints, roots))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in rows) == expected
    chosen = [r for r in rows if r["representative"]]
    assert len(chosen) == len(set(roots)) and all(r["doc_id"] == r["component_id"] for r in chosen)


def test_rows_keep_their_result_when_scans_are_split_anew(spark, prose, tmp_path, monkeypatch):
    texts = [prose(i // 2, 40) for i in range(64)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.repartition(16, "doc_id").write.parquet(str(tmp_path / "docs"))
    size, links = "spark.sql.files.maxPartitionBytes", simhash.near_links
    before = spark.conf.get(size)

    def later(*args):
        spark.conf.set(size, "16k")
        return links(*args)

    monkeypatch.setattr(simhash, "near_links", later)
    try:
        spark.conf.set(size, "128m")
        got = simhash.near_duplicates(spark.read.parquet(str(tmp_path / "docs"))).collect()
    finally:
        spark.conf.set(size, before)
    assert sorted((r["doc_id"], r["text"]) for r in got) == list(enumerate(texts))
    assert all(int(r["fingerprint"], 16) == plain_fingerprint(r["text"]) for r in got)
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 and r["representative"] == (r["doc_id"] % 2 == 0) for r in got)


def test_links_of_crowded_keys_and_other_schemes(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    values = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(300):
        v = centre
        for _ in range(rng.randrange(9)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(values)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    df = spark.createDataFrame(signed, "_print long")
    roots = plain_components(values, 4)
    for block in (16, 2048):
        found = {r["node"]: r["component"] for r in components(simhash.near_links(df, 4, block)).collect()}
        groups = {}
        for (s,), r in zip(signed, roots):
            groups.setdefault(r, set()).add(found.get(s, s))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_every_scheme_is_complete():
    for count in (10, 10**7, 10**10):
        choices = simhash.scheme(count, 4)
        rng = random.Random(count)
        for _ in range(2000):
            bits = set(rng.sample(range(64), 4))
            assert any(len(bits & set(c)) <= 1 for c in choices)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (2000, 1049)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[1000 + i] for i in range(50)} == {1000} and found[2000] == 1000
    assert len(found) == 92


def test_words_hash_by_content():
    a, b = substring.Words([b"alpha beta  gamma", None, b"", b"beta"]), substring.Words([b"beta"])
    assert a.counts.tolist() == [3, 0, 0, 1] and a.hash[1] == a.hash[3] == b.hash[0]
    assert len(np.unique(a.hash)) == 3
