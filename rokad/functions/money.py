"""Exact rupee-and-paise arithmetic on decimal columns."""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def zero() -> Column:
    return F.lit("0.00").cast(MONEY)


def money(value: Column) -> Column:
    """Round to two places, half away from zero."""
    return F.round(value.cast("decimal(20,4)"), 2).cast(MONEY)


def as_money(value: Column) -> Column:
    """Narrow an already exact amount (such as a widened sum) back to money."""
    return value.cast(MONEY)


def parse_money(text: Column) -> Column:
    """A clean decimal string with at most four places, rounded half up; null when malformed."""
    ok = text.rlike(r"^-?\d+(\.\d{1,4})?$")
    return F.when(ok, money(text.try_cast("decimal(20,4)")))


def pct(amount: Column, rate: Column) -> Column:
    """amount x rate percent, rounded half up to the paisa."""
    return F.round(amount.cast(MONEY) * rate.cast("decimal(6,3)") * F.lit(Decimal("0.01")), 2).cast(MONEY)


def half_rate(rate: Column) -> Column:
    """Half a percentage rate, cut (not rounded) to two places."""
    return F.floor(rate.cast("decimal(5,2)") * F.lit(Decimal("0.50")), 2).cast("decimal(5,2)")


def debit_of(signed: Column) -> Column:
    return F.greatest(signed, zero()).cast(MONEY)


def credit_of(signed: Column) -> Column:
    return F.greatest(-signed, zero()).cast(MONEY)


def nonnull(value: Column) -> Column:
    return F.coalesce(value, zero()).cast(MONEY)


def rupees(paise: Column) -> Column:
    """Whole paise (long) to money."""
    return (paise.cast("decimal(16,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def to_paise(amount: Column) -> Column:
    """Money to whole paise, for sums that should stay on primitive longs."""
    return (amount.cast(MONEY) * F.lit(100)).cast("long")


def pct_paise(amount: str, basis_points: str) -> Column:
    """amount x rate, both named long columns, rounded half up; the rate is in hundredths of a percent."""
    return F.expr(f"({amount} * {basis_points} + 5000) div 10000")
