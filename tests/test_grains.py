"""Results derived from sums at several grains equal those computed from the rows."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.anomalies import detect
from ledgerloom.operators.calendar import seasonal_calendar
from ledgerloom.operators.grains import ledger_grains
from ledgerloom.operators.metrics import kpis
from ledgerloom.operators.periods import tenant_stats
from ledgerloom.operators.segments import customer_segments
from ledgerloom.plans import analyze as whole


@pytest.fixture(scope="module")
def shops(make_ledger):
    rng = random.Random(8)
    rows = []
    for tenant, n in (("a", 900), ("b", 60), ("c", 3), ("returns", 5)):
        for _ in range(n):
            day = f"2026-{rng.randrange(1, 7):02d}-{rng.randrange(1, 28):02d}"
            moment = rng.choice([day, f"{day}T{rng.randrange(24):02d}:30:00"])
            amount = rng.choice([-20, 0, 15.5, 40, 99.99, 5000]) if tenant != "returns" else -3
            rows.append((tenant, moment, rng.choice([None, "x", "y", *"pqrstuvw"]), rng.choice([None, "tea", "pot", "oil", "rye"]), amount))
    return make_ledger(rows)


def rows_of(table):
    digits = [F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("string").alias(c) for c, t in table.dtypes if not t.startswith("map")]
    return sorted(map(str, table.select(*digits).collect()))


def test_kpis_anomalies_and_segments(spark, shops):
    grains = ledger_grains(shops)
    assert rows_of(grains.stats.select(*sorted(grains.stats.columns))) == rows_of(tenant_stats(shops).select(*sorted(grains.stats.columns)))
    for given in (None, "2026-05-15"):
        direct, summed = kpis(shops, given), kpis(shops, given, grains=grains)
        for name in direct:
            assert rows_of(direct[name]) == rows_of(summed[name]), name
        calendar = seasonal_calendar(spark)
        assert rows_of(detect(shops, calendar, given)) == rows_of(detect(shops, calendar, given, grains=grains))
        assert rows_of(customer_segments(shops, given)) == rows_of(customer_segments(grains.by_customer, given, grains.stats))


def test_the_cleaned_ledger_is_read_four_times(spark, shops, monkeypatch):
    plans = []

    def recorded(df, label, *more):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, label, *more)

    real = whole.staged
    monkeypatch.setattr(whole, "staged", recorded)
    monkeypatch.setattr("ledgerloom.operators.grains.staged", recorded)
    tables = whole.analyze(shops, "2026-08-01", merge_names=False)
    plans += [t._jdf.queryExecution().optimizedPlan().toString() for name, t in tables.items() if name != "ledger"]
    scans = [line for plan in plans for line in plan.splitlines() if "Relation [" in line and "flag_duplicate" in line]
    assert 3 <= len(scans) <= 4
