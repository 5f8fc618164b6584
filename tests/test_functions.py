import datetime

from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, text


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", column(F.col("v"))).orderBy("i").collect()]


def test_amounts(spark):
    cases = {
        "₹1,24,300": 124300, "(5000)": -5000, "5000 DR": 5000, "5000 CR": -5000, "15000.50": 15000.5, "$ 12": 12,
        "": 0, "nan": 0, "None": 0, "-": 0, "abc": 0, " 7 ": 7, "1e3": 1000, "-3.25": -3.25, "( 1,000 )": -1000,
        "(100) CR": 0, "12cr": 0, "()": 0,
    }
    got = values(spark, amounts.parse_amount, list(cases))
    assert {k: float(v) for k, v in zip(cases, got)} == {k: float(v) for k, v in cases.items()}
    assert values(spark, amounts.parse_amount, [None])[0] == 0


def test_voucher_amounts_flip_the_sign(spark):
    cases = {"-15000.00": 15000, "15000": -15000, "-1500.50": 1500.5, "0": 0, "": 0, "-": 0, "+": 0, "-1,24,300": 124300,
             "₹ -15,000": 15000}
    got = values(spark, amounts.parse_voucher_amount, list(cases))
    assert [float(v) for v in got] == list(cases.values())
    assert float(values(spark, lambda c: amounts.parse_voucher_amount(c, 1), ["12"])[0]) == 12


def test_rupee_format(spark):
    cases = {"15000": "₹15,000", "150000": "₹1,50,000", "12400000": "₹1,24,00,000", "0": "₹0", "-124300": "−₹1,24,300",
             "999.5": "₹1,000", "999.49": "₹999"}
    assert values(spark, lambda c: amounts.format_inr(c.cast("decimal(18,2)")), list(cases)) == list(cases.values())
    short = {12345678: "₹1.2 Cr", 150000: "₹1.5 L", 1250: "₹1.3 K", 39650: "₹39.6 K", 999: "₹999"}
    assert values(spark, amounts.format_inr_compact, list(short), "long") == list(short.values())


def test_expressions_run_from_left_to_right(spark):
    df = spark.createDataFrame([("2", "3", "4")], "a string, b string, c string")
    one = lambda e: float(df.select(amounts.amount_expression(e, df.columns)).first()[0])
    assert one("a + b * c") == 20 and one("c / a - b") == -1 and one("a / zero") == 0 and one("b * 1.5") == 4.5
    assert one("missing + a") == 2


def test_amount_strategies(spark):
    df = spark.createDataFrame([("2", "3", "4", "9")], "cr string, dr string, rate string, total string")
    one = lambda m: float(df.select(amounts.ledger_amount(m, df.columns)).first()[0])
    both = {"credit": "cr", "debit": "dr", "quantity": "cr", "unit_price": "rate"}
    assert one(both | {"amount": "total", "expression": "cr * dr"}) == 9
    assert one(both | {"expression": "cr * dr"}) == 6
    assert one(both) == -1
    assert one({"quantity": "cr", "unit_price": "rate"}) == 8


def test_dates(spark):
    day = datetime.datetime(2026, 1, 15)
    cases = {
        "15/01/2026": day, "15-1-26": day, "15/1/2026 08:26": day.replace(hour=8, minute=26), "2026-01-15": day,
        "2026-01-15 08:26:05": day.replace(hour=8, minute=26, second=5), "20260115": day, "15 Jan 2026": day,
        "15-JAN-26": day, "15/Jan/2026": day, "January 15, 2026": day, "15.01.2026": day, "1/15/2026": day,
        "12/1/2010 8:26": datetime.datetime(2010, 1, 12, 8, 26), "01-15-2026": day, "1/2/70": datetime.datetime(1970, 2, 1),
        "1/2/68": datetime.datetime(2068, 2, 1), " 15  Jan  2026 ": day, "31/02/2026": None, "soon": None, "nan": None,
        "": None, "-": None,
    }
    got = values(spark, dates.parse_date, list(cases))
    assert dict(zip(cases, got)) == cases


def test_dates_in_further_shapes(spark):
    cases = ["2026-01-02T10:00:00", "2026/01/05", "15-JAN-2026", "02-01-2026 10:30", "2026-01-02 10:30:00.0", "1 January 2026",
             "2026-01-02T10:00:00.123Z", "May 3, 2026", "32/01/2026", "2026-13-45", "", None]
    day = datetime.datetime
    assert values(spark, dates.parse_date, cases) == [
        day(2026, 1, 2, 10), day(2026, 1, 5), day(2026, 1, 15), day(2026, 1, 2, 10, 30), day(2026, 1, 2, 10, 30), day(2026, 1, 1),
        day(2026, 1, 2, 10), day(2026, 5, 3), None, None, None, None]


def test_numbers_too_large_are_null(spark):
    got = values(spark, amounts.parse_amount, ["1" * 40, "1e60", "12.5", "x1"])
    assert got[:2] == [None, None] and [float(v) for v in got[2:]] == [12.5, 0]
    rows = spark.createDataFrame([("1e25", "1e12"), ("3", "4")], "a string, b string")
    found = [r[0] for r in rows.select(amounts.amount_expression("a * b", ["a", "b"])).collect()]
    assert found[0] is None and float(found[1]) == 12


def test_voucher_dates(spark):
    as_of = F.lit("2026-05-01").cast("timestamp_ntz")
    got = values(spark, lambda c: dates.parse_voucher_date(c, as_of), ["20260115", "", None, "15-01-2026", "20261399"])
    assert got == [datetime.datetime(2026, 1, 15), datetime.datetime(2026, 5, 1), datetime.datetime(2026, 5, 1),
                   datetime.datetime(2026, 1, 15), None]


def test_whole_days_round_down(spark):
    rows = [("2026-01-02 06:00:00", "2026-01-01 18:00:00"), ("2026-01-03 18:00:00", "2026-01-01 18:00:00"),
            ("2026-01-01 06:00:00", "2026-01-01 18:00:00")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(dates.whole_days(F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz"))).collect()
    assert [r[0] for r in got] == [0, 2, -1]


def test_phones(spark):
    numbers = ["+91 98765-43210", "9876543210", "+91987654321", "(91) 9876543210", "+1234567890", "+12x"]
    phones = values(spark, text.clean_phone, numbers)
    assert phones == ["+919876543210", "+9876543210", "+91987654321", "+919876543210", "+1234567890", "+12x"]
    assert values(spark, lambda c: text.phone_is_valid(c), phones) == [True, True, False, True, True, False]


def test_small_texts(spark):
    assert values(spark, text.signed_percent, [4.25, -3.0, 0.0, None, 0.05], "double") == ["+4.3%", "-3.0%", "0%", "—", "+0.1%"]
    assert values(spark, text.printable, ["\ta\x00b\x7f  ", "x" * 150]) == ["ab", "x" * 150]
    assert values(spark, lambda c: text.printable(c, 100), ["x" * 150]) == ["x" * 100]
    assert values(spark, lambda c: text.fixed(c), [20.25, 1234.56, -0.5], "double") == ["20.2", "1234.6", "-0.5"]
    now = F.lit("2026-01-10 12:00:00").cast("timestamp_ntz")
    moments = ["2026-01-07 11:00:00", "2026-01-10 09:30:00", "2026-01-10 11:58:00", "2026-01-10 11:59:30"]
    ages = values(spark, lambda c: text.relative_time(c.cast("timestamp_ntz"), now), moments)
    assert ages == ["3d ago", "2h ago", "2m ago", "just now"]
    assert values(spark, text.quoted, ["a", "o'b", "o'\"b"])[:2] == ["'a'", '"o\'b"']
