"""Registration-number checks: layout, base-36 check digit, state and PAN parts."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The check-digit alphabet, the layout, and the state codes in use.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# the characters by quotient plus remainder of their doubled value: 0, 2, … 34 and 1, 3, … 35
DOUBLED = "".join(x for pair in zip(ALPHABET[:18], ALPHABET[18:], strict=True) for x in pair)
LAYOUT = r"^[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"
PAN_LAYOUT = r"^[A-Z]{5}[0-9]{4}[A-Z]$"
STATE_CODES = (
    "01", "02", "03", "04", "05", "06", "07", "08", "09", "10", "11", "12", "13",
    "14", "15", "16", "17", "18", "19", "20", "21", "22", "23", "24", "26", "27",
    "29", "30", "31", "32", "33", "34", "35", "36", "37", "38", "96", "97",
)


def check_digit(first14: Column) -> Column:
    """Weights 1,2,1,2,…; quotient plus remainder of division by 36; complement to a multiple of 36.

    What a character adds at an even place is its position in DOUBLED, so the sum is plain look-ups; a lambda over the places would be
    interpreted, and would evaluate the text 28 times.
    """
    total = sum((F.instr(F.lit(DOUBLED if i % 2 == 0 else ALPHABET), F.substring(first14, i, 1)) - 1 for i in range(2, 15)),
                F.instr(F.lit(ALPHABET), F.substring(first14, 1, 1)) - 1)
    return F.substring(F.lit(ALPHABET), (F.lit(36) - total % 36) % 36 + 1, F.lit(1))


def with_check_digit(first14: Column) -> Column:
    return F.concat(first14, check_digit(first14))


def gstin_reason(gstin: Column) -> Column:
    """Null when valid, else why not: empty, length, layout or check digit."""
    g = F.upper(F.trim(gstin))
    return (
        F.when(gstin.isNull() | (gstin == ""), F.lit("empty"))
        .when(F.length(g) != 15, F.lit("length"))
        .when(~g.rlike(LAYOUT), F.lit("layout"))
        .when(check_digit(F.substring(g, 1, 14)) != F.substring(g, 15, 1), F.lit("check_digit"))
    )


def state_of(gstin: Column) -> Column:
    return F.substring(gstin, 1, 2)


def pan_of(gstin: Column) -> Column:
    return F.substring(gstin, 3, 10)


def pan_valid(pan: Column) -> Column:
    return F.coalesce(pan.rlike(PAN_LAYOUT), F.lit(False))


def state_valid(code: Column) -> Column:
    return F.coalesce(code.isin(*STATE_CODES), F.lit(False))


def is_intra(supplier_gstin: Column, place_of_supply: Column) -> Column:
    return state_of(supplier_gstin) == place_of_supply
