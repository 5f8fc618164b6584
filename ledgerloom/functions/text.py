"""Text as column expressions, plus the one Arrow function for Unicode names."""

import pandas as pd
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.plans.shared import runs_in_tasks

runs_in_tasks(__name__)

IS_ASCII = r"^[\x00-\x7F]*$"


def name_or_default(raw: Column, default: str) -> Column:
    """The trimmed name, or `default` where it is blank or the word nan."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    return F.when((text == "") | (F.lower(text) == "nan"), F.lit(default)).otherwise(text)


def fill(template: str, **values: Column | str | int) -> Column:
    """A text with the names in braces replaced by columns or plain values; null where one of them is null."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [F.lit(part) if i % 2 == 0 else values[part] for i, part in enumerate(parts) if part]
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in pieces])


def first_filled(*candidates: Column, default: str) -> Column:
    """The first candidate that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates], F.lit(default))


def collapse_spaces(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def title_case_ascii(name: Column) -> Column:
    """A capital after every non-letter: o'brien 3m becomes O'Brien 3M.

    initcap only starts a word after a space, so a marked space is put between a non-letter and a letter and removed
    afterwards.
    """
    opened = F.regexp_replace(name, r"([^A-Za-z\s])(?=[A-Za-z])", "$1\u0001 ")
    return F.replace(F.initcap(opened), F.lit("\u0001 "), F.lit(""))


@F.pandas_udf(StringType())
def unicode_name(names: pd.Series) -> pd.Series:
    """NFC form with collapsed whitespace; only distinct non-ASCII names are sent here."""
    return names.str.normalize("NFC").str.split().str.join(" ")


@F.pandas_udf(StringType())
def unicode_title(names: pd.Series) -> pd.Series:
    return names.str.normalize("NFC").str.split().str.join(" ").str.title()


def quoted(name: Column) -> Column:
    """The name in single quotes, in double quotes when it holds a single quote."""
    mark = F.when(F.contains(name, F.lit("'")) & ~F.contains(name, F.lit('"')), '"').otherwise("'")
    return F.concat(mark, name, mark)


def fixed(value: Column, places: int = 1) -> Column:
    """Decimal text rounded by the exact binary value, true ties to the even digit.

    format_number rounds that way; the %.1f of format_string rounds the shortest decimal form and differs.
    """
    return F.replace(F.format_number(value.cast("double"), places), F.lit(","), F.lit(""))


def one_decimal_up(value: Column) -> Column:
    """One decimal by the exact binary value, true ties upwards; only quarters can be true ties."""
    return fixed(F.when(value * 4 == F.floor(value * 4), value + 0.001).otherwise(value))


def signed_percent(pct: Column) -> Column:
    """Trend text: +4.2%, -3.0%, 0%, or a dash where there is no earlier value."""
    return (
        F.when(pct.isNull(), "—")
        .when(pct > 0, F.concat(F.lit("+"), one_decimal_up(pct.cast("double")), F.lit("%")))
        .when(pct < 0, F.concat(F.lit("-"), one_decimal_up(-pct.cast("double")), F.lit("%")))
        .otherwise("0%")
    )


def relative_time(moment: Column, as_of: Column) -> Column:
    """Age of a moment: 3d ago, 2h ago, 5m ago, just now."""
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(moment.cast("timestamp"))
    return (
        F.when(seconds >= 86400, F.format_string("%dd ago", F.floor(seconds / 86400)))
        .when(seconds >= 3600, F.format_string("%dh ago", F.floor(seconds / 3600)))
        .when(seconds >= 60, F.format_string("%dm ago", F.floor(seconds / 60)))
        .otherwise("just now")
    )


def clean_phone(raw: Column) -> Column:
    """Spaces, dashes and brackets removed, a leading plus added."""
    digits = F.regexp_replace(F.trim(raw), r"[\s\-()]", "")
    return F.when(digits.startswith("+"), digits).otherwise(F.concat(F.lit("+"), digits))


def phone_is_valid(phone: Column) -> Column:
    """E.164 with 10 to 15 digits; Indian numbers must have exactly 10 after the country code."""
    return F.when(phone.startswith("+91"), phone.rlike(r"^\+91\d{10}$")).otherwise(phone.rlike(r"^\+\d{10,15}$"))


def phone_digest(phone: Column) -> Column:
    """First 12 hexadecimal digits of SHA-256, used in place of the number."""
    return F.substring(F.sha2(phone, 256), 1, 12)


def printable(text: Column, length: int | None = None) -> Column:
    """Control characters removed, trimmed; cut to `length` for display if one is given."""
    clean = F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")
    return F.trim(clean if length is None else F.substring(clean, 1, length))


def json_number(document: Column, path: str, to: str = "double") -> Column:
    return F.get_json_object(document, path).try_cast(to)
