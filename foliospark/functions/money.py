"""Exact decimal money. Values are rounded half up, once, where a price is published."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import WHITESPACE_CLASS, col

MONEY = "decimal(12,2)"
EXACT = "decimal(14,4)"

# Fixed value: no charge goes below one unit of currency.
MINIMUM_CHARGE = "1.00"


def lit_money(value: int | str) -> Column:
    return F.lit(str(value)).cast(MONEY)


def percent_of(amount: Column | str, percent: Column | str) -> Column:
    """``percent`` % of an amount with two decimals; exact in four decimals."""
    return (col(amount).cast(MONEY) * col(percent).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(EXACT)


def rounded(c: Column | str) -> Column:
    return F.round(col(c), 2).cast(MONEY)


def at_least_minimum(c: Column | str) -> Column:
    """Apply the minimum charge; an unknown amount stays unknown (``greatest`` would skip the null)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(MINIMUM_CHARGE).cast(EXACT)))


def cents(c: Column | str) -> Column:
    return F.round(col(c) * 100, 0).cast("long")


def from_cents(c: Column | str) -> Column:
    return (col(c).cast("decimal(14,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)


def parse_money(c: Column | str) -> Column:
    """Decimal prefix of a text, null when it does not start with a number."""
    digits = F.regexp_extract(col(c), rf"^{WHITESPACE_CLASS}*([+-]?[0-9]+(?:\.[0-9]+)?)", 1)
    return digits.try_cast(MONEY)
