import unicodedata

from pyspark.sql import functions as F

from ledgerloom.operators import cleaning, health


def test_flags(make_ledger):
    rows = [("a", "2026-01-01", "c", "p", 10)] * 3 + [("a", "2027-01-01", "c", "p", -10), ("b", "2026-01-01", None, "p", 1)]
    rows += [("b", "2026-01-01", None, "p", 1), ("a", None, "c", "p", 5)]
    flagged = cleaning.normalise(make_ledger(rows), "2026-06-01")
    got = {r["row_id"]: tuple(r[f] for f in cleaning.FLAGS) for r in flagged.collect()}
    assert got == {
        "000000": (False, False, False, False), "000001": (False, False, False, True),
        "000002": (False, False, False, True), "000003": (True, True, False, False),
        "000004": (False, False, False, False), "000005": (False, False, False, True),
    }


def test_extreme_needs_four_rows_and_spread(make_ledger):
    rows = [("a", "2026-01-01", "c", f"p{i}", 10) for i in range(20)] + [("a", "2026-01-01", "c", "x", 1000)]
    rows += [("b", "2026-01-01", "c", "x", 1), ("b", "2026-01-01", "c", "y", 9999), ("b", "2026-01-01", "c", "z", 1)]
    flagged = cleaning.flag_extreme(make_ledger(rows))
    assert [r["product"] for r in flagged.filter("flag_extreme_amount").collect()] == ["x"]


def test_one_set_of_copies_may_be_most_of_the_ledger(spark, make_ledger):
    one = make_ledger([("a", "2026-01-01", "c", "p", 10)])
    copies = one.crossJoin(spark.range(5000)).withColumn("row_id", F.format_string("%08d", "id")).drop("id")
    flagged = cleaning.flag_duplicates(copies)
    assert flagged.filter("flag_duplicate").count() == 4999
    assert flagged.filter("not flag_duplicate").first()["row_id"] == "00000000"


def test_both_ways_of_flagging_agree(make_ledger):
    rows = [("a", f"2026-01-{i % 3 + 1:02d}", None if i % 2 else "c", "p", i % 5) for i in range(60)]
    ledger = make_ledger(rows)
    few, many = (cleaning.flag_duplicates(ledger, broadcast_rows=n) for n in (1000, 0))
    assert sorted(few.collect(), key=str) == sorted(many.collect(), key=str)
    assert few.filter("not flag_duplicate").count() == len(set(rows))


def test_names_are_as_python_would_write_them(make_ledger):
    names = ["  o'brien   mc-donald 3m ", "RAM\tkumar", "émile  ZOLA", "शर्मा  ट्रेडर्स", "école x", "a1b2 c", ""]
    ledger = make_ledger([("a", "2026-01-01", n, n, 1) for n in names])
    got = {r["row_id"]: (r["customer"], r["product"]) for r in cleaning.normalise_names(ledger).collect()}
    for i, name in enumerate(names):
        clean = " ".join(unicodedata.normalize("NFC", name).split())
        assert got[f"{i:06d}"] == (clean.title(), clean)


def test_health(make_ledger):
    good = [("good", f"2026-01-{d:02d}", f"c{d}", "p", 100 + d) for d in range(1, 29)]
    few = [("few", "2026-01-01", "c", "p", 1)] * 4
    copies = [("copies", f"2026-01-{d % 7 + 1:02d}", "c", "p", 5) for d in range(28)]
    late = [("late", f"2030-01-{d:02d}", f"c{d}", "p", d) for d in range(1, 29)]
    report = {r["tenant"]: r for r in health.health(
        cleaning.normalise(make_ledger(good + few + copies + late), "2026-06-01")).collect()}
    assert report["good"]["score"] >= 70 and report["good"]["can_analyze"]
    assert report["few"]["score"] == 0 and not report["few"]["can_analyze"] and report["few"]["usable_rows"] == 4
    assert report["copies"]["uniqueness_score"] == 5
    assert report["late"]["validity_score"] == 10 and not report["late"]["can_analyze"]
    for row in report.values():
        parts = [row[p] for p in ("completeness_score", "consistency_score", "validity_score", "uniqueness_score")]
        assert row["score"] == sum(parts)
    gated = health.analysable(make_ledger(good + few), health.health(make_ledger(good + few)))
    assert {r["tenant"] for r in gated.select("tenant").distinct().collect()} == {"good"}


def test_missing_amounts_and_columns(make_ledger):
    rows = [("a", f"2026-01-{d:02d}", "c", "p", None if d % 2 else d) for d in range(1, 21)]
    report = health.health(make_ledger(rows)).first()
    assert report["completeness_score"] == 20
    assert "Column 'amount' has 50.0% missing values." in report["issues"]
    report = health.health(make_ledger(rows).drop("amount", "customer")).first()
    assert report["completeness_score"] == 13
    assert "Required column 'amount' is missing entirely." in report["issues"]


def test_sample_takes_a_share_by_hash(make_ledger):
    ledger = make_ledger([("a", "2026-01-01", "c", str(i), 1) for i in range(2000)])
    drawn = {r["row_id"] for r in cleaning.sample_ledger(ledger, 0.3).collect()}
    assert 500 < len(drawn) < 700
    assert drawn < {r["row_id"] for r in cleaning.sample_ledger(ledger, 0.6).collect()}
    assert cleaning.sample_ledger(ledger, 1).count() == 2000 and cleaning.sample_ledger(ledger, 0).count() == 0


def test_many_repeated_keys_are_not_copied(spark, make_ledger):
    """Every row twice: the firsts are too many to broadcast, and no step makes more rows than the ledger has."""
    one = make_ledger([("a", "2026-01-01", "c", "p", 10)]).crossJoin(spark.range(2000))
    twice = one.withColumn("customer", F.col("id").cast("string")).drop("id").crossJoin(spark.range(2)).withColumn(
        "row_id", F.format_string("%s-%d", "customer", "id")).drop("id")
    flagged = cleaning.flag_duplicates(twice, broadcast_rows=0)
    assert "_salt" not in flagged._jdf.queryExecution().toString()
    assert {r["row_id"][-1] for r in flagged.filter("flag_duplicate").collect()} == {"1"}
    assert flagged.filter("not flag_duplicate").count() == 2000


def test_keys_with_too_many_rows_for_one_task(make_ledger):
    rows = [("a", "2026-01-01", None, "p", 1)] * 500 + [("a", f"2026-01-{i % 28 + 1:02d}", f"c{i % 40}", "p", 2) for i in range(300)]
    rows += [(None, "2026-01-01", "c", "p", 1)] * 3
    ledger = make_ledger(rows)
    expected = sorted(cleaning.flag_duplicates(ledger).collect(), key=str)
    for few in (0, 1000):
        crowds = cleaning.flag_duplicates(ledger, broadcast_rows=few, window_rows=100)
        assert sorted(crowds.collect(), key=str) == expected
    assert sum(r["flag_duplicate"] for r in expected) == 499 + 300 - 280


def test_many_unicode_names_stay_where_they_are(make_ledger):
    """Names that are too many to broadcast are written like the others, without being shuffled."""
    names = ["  o'brien ", "émile  ZOLA", "शर्मा  ट्रेडर्स", "école X", None, "plain"]
    ledger = make_ledger([("a", "2026-01-01", n, m, 1) for n in names for m in names])
    many = cleaning.normalise_names(ledger, broadcast_rows=0)
    assert sorted(many.collect(), key=str) == sorted(cleaning.normalise_names(ledger).collect(), key=str)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
