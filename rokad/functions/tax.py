"""Goods-and-services tax on a line and on a whole document."""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import MONEY, half_rate, money, pct, zero

INPUT_RATE = "decimal(5,2)"


def taxable_value(quantity: Column, unit_price: Column, discount: Column) -> Column:
    """Quantity and price are rounded to two places, their product is cut to the paisa."""
    gross = F.floor(
        F.round(quantity.cast("decimal(18,4)"), 2) * F.round(unit_price.cast("decimal(18,4)"), 2), 2
    )
    return (gross.cast(MONEY) - F.coalesce(money(discount), zero())).cast(MONEY)


def line_tax(
    taxable: Column, rate: Column, cess_rate: Column, treatment: Column, intra: Column
) -> dict[str, Column]:
    """cgst, sgst, igst and cess of one line. Only the 'taxable' treatment is charged."""
    charged = treatment == "taxable"
    half = pct(taxable, half_rate(rate))
    return {
        "cgst": F.when(charged & intra, half).otherwise(zero()),
        "sgst": F.when(charged & intra, half).otherwise(zero()),
        "igst": F.when(charged & ~intra, pct(taxable, rate)).otherwise(zero()),
        "cess": F.when(charged, pct(taxable, F.coalesce(cess_rate, F.lit(0)))).otherwise(zero()),
    }


def round_off(before: Column) -> Column:
    """Signed amount that takes a total to the nearest rupee, half up."""
    return (F.round(before, 0) - before).cast(MONEY)


def tax_matches(
    taxable: Column, rate: Column, intra: Column, cgst: Column, sgst: Column, igst: Column
) -> Column:
    """True when the stated heads equal an independent recomputation."""
    exp = line_tax(taxable, rate, F.lit(0), F.lit("taxable"), intra)
    return (
        (F.coalesce(cgst, zero()) == exp["cgst"])
        & (F.coalesce(sgst, zero()) == exp["sgst"])
        & (F.coalesce(igst, zero()) == exp["igst"])
    )


# Rates a customer plausibly withholds, in the order they are tried.
WITHHELD_RATES = [
    ("0.1", "purchase of goods"),
    ("1", "contractor — individual/HUF"),
    ("2", "contractor — company"),
    ("5", "commission or brokerage"),
    ("10", "professional or technical fees / rent"),
]


def withheld_rate(total: Column, taxable: Column, received: Column, slack: str = "1.00") -> Column:
    """Struct(shortfall, rate, section): the first rate whose tax explains the shortfall."""
    shortfall = (total - received).cast(MONEY)
    rate, section = F.lit(None).cast("decimal(6,3)"), F.lit(None).cast("string")
    for text, name in reversed(WITHHELD_RATES):
        near = F.abs(pct(taxable, F.lit(Decimal(text))) - shortfall) <= F.lit(Decimal(slack))
        rate = F.when(near, F.lit(Decimal(text)).cast("decimal(6,3)")).otherwise(rate)
        section = F.when(near, F.lit(name)).otherwise(section)
    owed = shortfall > 0
    return F.struct(
        shortfall.alias("shortfall"),
        F.when(owed, rate).alias("rate"),
        F.when(owed, section).alias("section"),
    )
