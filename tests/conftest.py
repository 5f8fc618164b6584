import datetime
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerloom.ledger import LEDGER_SCHEMA  # noqa: E402
from ledgerloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_ledger(spark):
    """Ledger from (tenant, date, customer, product, amount) tuples, numbered in the order given."""

    def make(rows):
        full = [
            (t, f"{i:06d}", f"V{i}", datetime.datetime.fromisoformat(str(d)) if d else None, c, p,
             None if a is None else Decimal(str(a)), 1.0, None, "test")
            for i, (t, d, c, p, a) in enumerate(rows)
        ]
        return spark.createDataFrame(full, LEDGER_SCHEMA)

    return make


@pytest.fixture(scope="session")
def clean_sales(make_ledger):
    """Eleven weeks of five wares sold to one customer each; for the last three weeks two of them stay on the shelf."""
    opening = datetime.date(2025, 12, 29)
    wares = {"Lamp Oil": "Harbour Inn", "Candle Box": "St. Anne", "Jute Rope": "Boatyard", "Tin Pail": "Dairy", "Floor Wax": "School"}
    rows = []
    for number in range(66):
        week, day = divmod(number, 6)
        for place, (ware, buyer) in enumerate(wares.items(), 1):
            if week < 8 or place <= 3:
                price = 1700 * place + (90 * week if week < 8 else 0)
                rows.append(("shop", opening + datetime.timedelta(weeks=week, days=day), buyer, ware, price))
    return make_ledger(rows)
