import numpy as np
import pandas as pd
import pytest

from ledgerloom.operators import segments

METRICS = {"recency_days": True, "frequency": False, "monetary": False}


def pandas_score(series, low_is_good):
    """Quintile scores as pandas gives them, with its two fallbacks."""
    if series.nunique() < 5:
        ranked = series.rank(method="first", ascending=not low_is_good)
        return pd.cut(ranked, bins=5, labels=[1, 2, 3, 4, 5]).astype(int)
    labels = [5, 4, 3, 2, 1] if low_is_good else [1, 2, 3, 4, 5]
    try:
        return pd.qcut(series, q=5, labels=labels, duplicates="drop").astype(int)
    except ValueError:
        median = series.median()
        low, high = (5, 1) if low_is_good else (1, 5)
        return pd.Series(np.select([series < median, series > median], [low, high], 3), index=series.index)


@pytest.fixture(scope="module")
def base(spark):
    rng = np.random.default_rng(7)
    frames = []
    for number, size in enumerate((1, 2, 3, 4, 6, 7, 11, 40, 133, 500)):
        for kind in range(3):
            spread = (3, 12, 1000)[kind]
            frames.append(pd.DataFrame({
                "tenant": f"t{number}-{kind}", "customer": [f"c{i:05d}" for i in range(size)],
                "recency_days": rng.integers(0, spread, size), "frequency": rng.integers(1, spread, size),
                "monetary": rng.integers(0, spread * 10, size) / 4,
            }))
    return pd.concat(frames)


@pytest.mark.parametrize("window_rows", [None, 5])
def test_scores_equal_pandas(spark, base, window_rows):
    expected = base.set_index(["tenant", "customer"])
    got = segments.score_customers(spark.createDataFrame(base), window_rows).toPandas().set_index(["tenant", "customer"])
    for metric, low_is_good in METRICS.items():
        for tenant, series in expected[metric].groupby(level=0):
            score = pandas_score(series, low_is_good)
            assert (got.loc[score.index, metric[0] + "_score"] == score).all(), (tenant, metric)


def test_segment_rules(spark):
    from pyspark.sql import functions as F

    rows = [(5, 5, 5, "Champion"), (3, 3, 1, "Loyal"), (5, 1, 1, "Potential"), (1, 3, 3, "At Risk"), (1, 1, 1, "Lost"),
            (3, 2, 5, "Average"), (1, 1, 5, "Average")]
    df = spark.createDataFrame(rows, "r int, f int, m int, expected string")
    assert df.filter(segments.segment_of(F.col("r"), F.col("f"), F.col("m")) != F.col("expected")).count() == 0


def test_returns_count_for_frequency_not_for_money(make_ledger):
    ledger = make_ledger([("a", "2026-01-01", "c", "p", 10), ("a", "2026-01-09", "c", "p", -4),
                          ("a", "2026-01-11", "d", "p", 1)])
    row = segments.rfm_base(ledger).filter("customer = 'c'").first()
    assert (row["recency_days"], row["frequency"], row["monetary"]) == (2, 2, 10.0)
