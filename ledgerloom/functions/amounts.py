"""Money as column expressions: parsing, arithmetic on parsed amounts, display formats."""

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.fixed_values import NULL_WORDS
from ledgerloom.functions.text import one_decimal_up

# Amounts are computed at this precision and stored as decimal(18,2).
WIDE = "decimal(38,6)"


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _number(cleaned: Column) -> Column:
    """Decimal value of a cleaned string, 0 where it is no number, null where the number is too large to hold."""
    return F.when(cleaned.rlike(NUMBER), cleaned.try_cast(WIDE)).otherwise(F.lit(0).cast(WIDE))


def parse_amount(raw: Column) -> Column:
    """Amount of a spreadsheet or CSV cell.

    Handles the rupee and dollar signs, Indian comma grouping, accounting brackets and a trailing CR (negative) or
    DR after a space. Null words and anything unparsable give 0.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    bracketed = text.startswith("(") & text.endswith(")") & (F.length(text) > 1)
    body = F.when(bracketed, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    suffix = F.upper(F.right(body, F.lit(3)))
    is_credit, is_debit = suffix == " CR", suffix == " DR"
    body = F.when(is_credit | is_debit, F.left(body, F.length(body) - 3)).otherwise(body)
    value = _number(F.regexp_replace(body, r"[₹$,\s]", ""))
    value = F.when(bracketed | is_credit, -value).otherwise(value)
    return F.when(F.lower(text).isin(*NULL_WORDS), F.lit(0)).otherwise(value).cast(WIDE)


def parse_voucher_amount(raw: Column, sale_sign: int = -1) -> Column:
    """Amount of an accounting-XML ledger line; with `sale_sign` -1 a negative source amount is a sale."""
    cleaned = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"[₹,\s]", "")
    return (_number(cleaned) * F.lit(sale_sign)).try_cast(WIDE)


def amount_expression(expression: str, columns: list[str] | Callable[[str], Column]) -> Column:
    """Arithmetic over parsed cells, evaluated strictly from left to right without operator precedence.

    Names that are neither a column nor a number count as 0, and so does a division by 0. A result too large to hold is null.
    Where columns differ from row to row, a function gives the cell of a name, null where a row has no such column.
    """

    def operand(token: str) -> Column:
        if callable(columns):
            cell = columns(token)
            return F.when(cell.isNotNull(), parse_amount(cell)).otherwise(_number(F.lit(token)))
        if token in columns:
            return parse_amount(F.col(f"`{token}`"))
        return _number(F.lit(token))

    pieces = [p.strip() for p in re.split(r"([-+*/])", expression)]
    pieces = [p for p in pieces if p]
    operands = [operand(p) for p in pieces if p not in "+-*/"]
    operators = [p for p in pieces if p in "+-*/"]
    if not operands:
        return F.lit(0).cast(WIDE)
    steps = {
        "+": F.try_add,
        "-": F.try_subtract,
        "*": F.try_multiply,
        "/": lambda a, b: F.when(b == 0, F.lit(0)).otherwise(F.try_divide(a, b)),
    }
    result = operands[0]
    for operator, right in zip(operators, operands[1:]):
        result = steps[operator](result, right).try_cast(WIDE)
    return result


def ledger_amount(column_map: dict[str, str], columns: list[str]) -> Column:
    """The amount of a row: direct column, else expression, else credit less debit, else quantity times price.

    Null where a number on the way is too large to hold.
    """

    def cell(field: str) -> Column:
        return parse_amount(F.col(f"`{column_map[field]}`")) if field in column_map else F.lit(0).cast(WIDE)

    if "amount" in column_map:
        return cell("amount")
    if column_map.get("expression"):
        return amount_expression(column_map["expression"], columns)
    if "credit" in column_map or "debit" in column_map:
        return F.try_subtract(cell("credit"), cell("debit"))
    return F.try_multiply(cell("quantity"), cell("unit_price")).try_cast(WIDE)


def format_inr(amount: Column) -> Column:
    """Whole rupees, half up, in lakh/crore grouping: 124300 becomes ₹1,24,300; a minus is U+2212."""
    whole = F.round(amount.cast("decimal(38,6)"), 0).cast("decimal(38,0)")
    digits = F.abs(whole).cast("string")
    head = F.left(digits, F.length(digits) - 3)
    grouped = F.concat(F.regexp_replace(head, r"(\d)(?=(\d\d)+$)", "$1,"), F.lit(","), F.right(digits, F.lit(3)))
    text = F.when(F.length(digits) > 3, grouped).otherwise(digits)
    return F.concat(F.when(whole < 0, "−").otherwise(""), F.lit("₹"), text)


def format_inr_compact(amount: Column) -> Column:
    """Short form: crore, lakh or thousand with one decimal, whole rupees below 1,000."""
    value = amount.cast("double")

    def short(unit: float, name: str) -> Column:
        return F.concat(F.lit("₹"), one_decimal_up(value / unit), F.lit(name))

    return (
        F.when(value >= 1e7, short(1e7, " Cr"))
        .when(value >= 1e5, short(1e5, " L"))
        .when(value >= 1e3, short(1e3, " K"))
        .otherwise(F.regexp_replace(format_inr(amount), "^−", "-"))
    )


def rupees(amount: Column) -> Column:
    """Rounded rupees with thousands separators, as used inside message texts."""
    return F.concat(F.lit("₹"), F.format_number(amount.cast("double"), 0))
