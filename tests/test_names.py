import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import product_names as names


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def spellings():
    """Names with a common beginning, and misspelt copies of them."""
    rng = random.Random(3)
    words = ["biscuit", "butter", "noodles", "salt", "soap", "शक्कर", "tea"]
    made = set()
    for _ in range(90):
        name = "Shop brand " * rng.randint(0, 1) + " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        made.add(name)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice(["", "x", name[at] * 2]) + name[at + 1:]
        made.add(name)
    return sorted(made)


@pytest.mark.parametrize("crowded_pairs", [10_000, 200, 20])
@pytest.mark.parametrize("threshold", [85, 70])
def test_no_pair_is_missed(spark, spellings, crowded_pairs, threshold):
    df = spark.createDataFrame([("t", n, 2) for n in spellings], "tenant string, name string, n long")
    got = {(r["name_a"], r["name_b"]) for r in names.similar_pairs(df, threshold, crowded_pairs).collect()}
    expected = {
        tuple(sorted((a, b), key=lambda s: s.encode()))
        for i, a in enumerate(spellings) for b in spellings[i + 1:]
        if edits(a, b) * 100 <= (100 - threshold) * max(len(a), len(b))
    }
    assert got == expected


def test_long_chains_become_one_group(spark):
    nodes = spark.range(60).select(F.lit("t").alias("tenant"), F.format_string("n%03d", "id").alias("name"))
    pairs = spark.range(59).filter("id != 40").select(
        F.lit("t").alias("tenant"), F.format_string("n%03d", "id").alias("name_a"),
        F.format_string("n%03d", F.col("id") + 1).alias("name_b"),
    )
    labels = {r["name"]: r["label"] for r in names.connected_groups(nodes, pairs).collect()}
    assert set(labels.values()) == {"n000", "n041"} and labels["n040"] == "n000" and labels["n059"] == "n041"


def test_canonical_name_is_the_longest(make_ledger):
    rows = [("a", "2026-01-01", "c", p, 1) for p in ["Soda Ashes"] * 3 + ["Soda Ashesl"] * 2 + ["Rock Salt"] * 2 + ["Rock Sallt"]]
    merged, mapping = names.merge_product_names(make_ledger(rows))
    assert {r["product"]: r["count"] for r in merged.groupBy("product").count().collect()} == {
        "Soda Ashesl": 5, "Rock Salt": 2, "Rock Sallt": 1,
    }
    assert mapping.filter("name = 'Soda Ashes'").first()["canonical"] == "Soda Ashesl"


def test_numbered_names_are_joined_without_their_pairs(spark):
    rows = [("t", f"Samsung Galaxy Phone Model {i:05d}", 2) for i in range(3000)] + [("t", "Rock Salt Packet Family", 2), ("t", "Rock Salt Packet Famili", 3)]
    counts = spark.createDataFrame(rows, "tenant string, name string, n long")
    assert names.sure_links(counts).count() < 20 * len(rows)
    found = names.canonical_names(counts)
    assert {r["canonical"][:12]: r["count"] for r in found.groupBy("canonical").count().collect()} == {"Samsung Gala": 3000, "Rock Salt Pa": 2}


def test_bags_of_words(spark):
    from ledgerloom.operators.name_words import bag

    cases = {"Salt Rock 1kg": "1 kg rock salt", "Rock Salt 1 kg": "1 kg rock salt", " ROCK-salt, 1KG ": "1 kg rock salt", "चाय 250g चाय": "250 g चाय चाय", "--": ""}
    df = spark.createDataFrame(list(cases.items()), "name string, expected string")
    assert df.filter(bag(F.col("name")) != F.col("expected")).count() == 0


def test_groups_by_words_against_all_pairs(spark):
    from ledgerloom.operators.name_words import bag, canonical_by_words

    rng = random.Random(11)
    words = ["rock", "salt", "sugar", "tea", "green", "brown", "pure", "500", "1", "kg", "g", "सोप"]
    made = {"Salt Rock 1kg", "Rock Salt 1 kg", "Rocck salt 1kg", "Rock Salt", "--"}
    while len(made) < 90:
        name = [rng.choice(words) for _ in range(rng.randint(1, 4))]
        made |= {" ".join(name), "".join(w.title() + rng.choice([" ", "-"]) for w in reversed(name))}
    df = spark.createDataFrame([("t", n, 2 + len(n) % 3) for n in sorted(made)], "tenant string, name string, n long")
    got = {r["name"]: r["canonical"] for r in canonical_by_words(df).collect()}
    bags = {r["name"]: r["bag"] for r in df.select("name", bag(F.col("name")).alias("bag")).collect() if r["bag"]}

    def linked(a, b):
        inner, outer = sorted((a, b), key=len)
        sets = {x: set(x.split()) for x in (a, b)}
        contained = any(len(sets[x]) >= 2 and sets[x] <= sets[y] and len(y) < 1.5 * len(x) for x, y in ((a, b), (b, a)))
        return contained or edits(a, b) * 100 <= 15 * len(outer)

    nodes = sorted(set(bags.values()))
    label = {b: b for b in nodes}
    for _ in nodes:
        for a in nodes:
            for b in nodes:
                if label[a] != label[b] and linked(a, b):
                    low = min(label[a], label[b])
                    label[a] = label[b] = low
    expected = {}
    for name, b in bags.items():
        group = [n for n, x in bags.items() if label[x] == label[b]]
        expected[name] = min(group, key=lambda n: (-len(n), -(2 + len(n) % 3), n.encode()))
    assert got == expected
    assert got["Salt Rock 1kg"] == got["Rock Salt 1 kg"] == got["Rocck salt 1kg"] and "--" not in got
