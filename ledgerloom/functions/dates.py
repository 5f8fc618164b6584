"""Dates as column expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.fixed_values import DATE_FORMATS

# Common shapes tried after the fixed list: year first with slashes, times after dashes or dots, months in words.
FURTHER_DATE_FORMATS = (
    "yyyy/M/d", "yyyy/M/d H:m", "yyyy/M/d H:m:s", "yyyy.M.d", "d-M-yyyy H:m", "d-M-yyyy H:m:s", "d.M.yyyy H:m",
    "d.M.yyyy H:m:s", "d MMMM yyyy", "MMM d, yyyy", "d-MMM-yyyy H:m", "d-MMM-yyyy H:m:s", "d MMM yyyy H:m", "d MMM yyyy H:m:s",
    "yyyyMMdd H:m:s",
)

# Marks that stand for runs of letters and digits in the shape of a text, replaced in this order.
SHAPE_MARKS = (
    ("[A-Za-z]{4,}", "<>"), ("[A-Za-z]{3}", "<"), ("(?<![0-9])[0-9]{8}(?![0-9])", "="), ("(?<![0-9])[0-9]{4}(?![0-9])", "+"),
    ("(?<![0-9])[0-9]{1,2}(?![0-9])", "_"),
)
PATTERN_MARKS = {"yyyyMMdd": "=", "yyyy": "+", "MMMM": "<>", "MMM": "<", **dict.fromkeys(("yy", "M", "d", "H", "m", "s"), "_")}


def shapes_of(pattern: str) -> list[str]:
    """Shapes of the texts that can fit a datetime pattern; a full month name may have three letters."""
    shape = "".join(PATTERN_MARKS.get(p, p) for p in re.split(r"([A-Za-z]+)", pattern))
    return [shape, shape.replace("<>", "<")] if "<>" in shape else [shape]


def parse_date(raw: Column) -> Column:
    """First of the known formats that fits, day before month; null where none does.

    A `T` between date and time, fractions of a second and a closing Z are set aside first. The shape of the text picks
    its format, and a second one where day and month could be swapped, so at most two attempts are made per row. Two-digit
    years 69-99 belong to the 1900s, as in POSIX.
    """
    text = F.regexp_replace(F.trim(raw), r"\s+", " ")
    text = F.regexp_replace(text, r"([0-9])T([0-9])", "$1 $2")
    text = F.regexp_replace(text, r"(:[0-9]{1,2})(\.[0-9]+)?Z?$", "$1")
    by_shape: dict[str, list[str]] = {}
    for pattern in (*DATE_FORMATS, *FURTHER_DATE_FORMATS):
        for shape in shapes_of(pattern):
            by_shape.setdefault(shape, []).append(pattern)
    shape = text
    for run, mark in SHAPE_MARKS:
        shape = F.regexp_replace(shape, run, mark)

    def known(n: int) -> Column:
        pairs = [F.lit(x) for key, patterns in by_shape.items() if len(patterns) > n for x in (key, patterns[n])]
        return F.try_element_at(F.create_map(*pairs), shape)

    parsed = F.coalesce(F.try_to_timestamp(text, known(0)), F.try_to_timestamp(text, known(1))).cast("timestamp_ntz")
    centuries = F.when(text.rlike("[^0-9][0-9]{2}$") & ~text.rlike("[0-9]{4}") & (F.year(parsed) >= 2069), 100)
    return parsed - F.make_ym_interval(F.coalesce(centuries, F.lit(0)))


def parse_voucher_date(raw: Column, as_of: Column) -> Column:
    """yyyyMMdd, or any other known format; a blank date means `as_of`, anything else is null.

    Eight digits are what exports hold, and have no other reading: they are read without the search for the format.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    plain = F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("timestamp_ntz")
    return F.when(text == "", as_of.cast("timestamp_ntz")).when(text.rlike(r"^[0-9]{8}\z"), plain).otherwise(parse_date(text))


def whole_days(later: Column, earlier: Column) -> Column:
    """Days from `earlier` to `later`, rounded down to whole 24-hour days."""

    def time_of_day(moment: Column) -> Column:
        return moment - F.to_date(moment).cast("timestamp_ntz")

    partial = time_of_day(later) < time_of_day(earlier)
    return F.datediff(F.to_date(later), F.to_date(earlier)) - F.when(partial, 1).otherwise(0)


def week_ending(moment: Column) -> Column:
    """The Sunday that closes the week of `moment`."""
    return F.date_add(F.trunc(F.to_date(moment), "week"), 6)


def day_shift(moment: Column, days: Column) -> Column:
    """`moment` moved by a whole number of days given as a column."""
    return moment + F.make_dt_interval(days.cast("int"))


def as_moment(value) -> Column:
    """A timestamp column from a date, datetime, ISO string or column."""
    return (value if isinstance(value, Column) else F.lit(str(value))).cast("timestamp_ntz")
