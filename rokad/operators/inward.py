"""Books against the suppliers' inward statement: one status for every bill and every statement line, each used once.

Passes, each on what the ones before left over: pairs made by a person; equal normalised numbers; equal date, value and tax; and near ones,
chosen by rounds of mutual best choice. Candidates of the last pass come from equi joins only: cells of date and value around
each row, and, for numbers one edit apart on one date, the number with each of its characters left out.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.money import MONEY, rupees, to_paise
from .pairing import mutual_best, rank_pairs, without
from .staging import stage

PARTY = ["client_id", "supplier_gstin"]
#: Paise by which value and tax may differ, and days by which the date may, in a suggested match.
SLACK, DAYS = 100, 5


def _tax() -> Column:
    return to_paise((F.col("cgst") + F.col("sgst") + F.col("igst")).cast(MONEY))


def book_side(bills: DataFrame) -> DataFrame:
    return bills.filter("supplier_gstin IS NOT NULL AND NOT is_return").select(
        F.col("voucher_id").alias("id"), *PARTY, text.norm_invoice_no(F.col("bill_number")).alias("number"), F.col("bill_number").alias("raw"),
        F.col("bill_date").alias("day"), to_paise(F.col("taxable")).alias("value"), _tax().alias("tax"))


def statement_side(inward: DataFrame) -> DataFrame:
    return inward.select(
        F.col("line_id").alias("id"), *PARTY, text.norm_invoice_no(F.col("invoice_number")).alias("number"), F.col("invoice_number").alias("raw"),
        F.col("invoice_date").alias("day"), to_paise(F.col("taxable")).alias("value"), _tax().alias("tax"), "is_amended", "ims_action")


def _day(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date"))


def _by_value(books: DataFrame, lines: DataFrame, slack: int, days: int) -> DataFrame:
    """Pairs with value, tax and date inside the limits: a row of the books looks into the cells its limits reach, four at most."""
    def cells(x: Column, reach: int) -> Column:
        width = 2 * reach + 1
        return F.explode(F.array_distinct(F.array(F.floor((x - reach) / width), F.floor((x + reach) / width))))
    probes = books.withColumn("_d", cells(_day(F.col("day")), days)).withColumn("_v", cells(F.col("value"), slack))
    held = lines.select(*PARTY, F.col("id").alias("r"), F.col("number").alias("r_number"), F.col("day").alias("r_day"), F.col("value").alias("r_value"), F.col("tax").alias("r_tax"),
                        F.floor(_day(F.col("day")) / (2 * days + 1)).alias("_d"), F.floor(F.col("value") / (2 * slack + 1)).alias("_v"))
    return probes.join(held, [*PARTY, "_d", "_v"]).filter(_close(slack, days)).selectExpr(*PAIR)


PAIR = ["id AS l", "r", "number", "r_number", "day", "r_day", "value", "r_value", "tax", "r_tax"]


def _close(slack: int, days: int) -> Column:
    return (F.abs(F.col("value") - F.col("r_value")) <= slack) & (F.abs(F.col("tax") - F.col("r_tax")) <= slack) & (
        F.abs(F.datediff("day", "r_day")) <= days)


def _by_number(books: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs of one date whose normalised numbers are one edit apart: both then share the number or one of its forms with a character less."""
    def forms(number: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.concat(F.substring(number, F.lit(1), i - 1), F.substring(number, i + 1, F.length(number))))
        return F.explode(F.array_distinct(F.concat(F.array(number), F.when(F.length(number) > 0, cut).otherwise(F.array().cast("array<string>")))))
    probes = books.withColumn("_f", forms(F.col("number")))
    held = lines.select(*PARTY, F.col("id").alias("r"), F.col("number").alias("r_number"), F.col("day").alias("r_day"), F.col("value").alias("r_value"), F.col("tax").alias("r_tax"),
                        F.col("day"), forms(F.col("number")).alias("_f"))
    return probes.join(held, [*PARTY, "day", "_f"]).filter(F.levenshtein("number", "r_number") <= 1).selectExpr(*PAIR)


def reconcile(bills: DataFrame, inward: DataFrame, manual: DataFrame, slack: int = SLACK, days: int = DAYS) -> DataFrame:
    """client_id, supplier_gstin, voucher_id, bill_number, invoice_number, b_taxable, g_taxable, status, matched_by of every row of both sides.

    manual has client_id, supplier_gstin, bill_number and invoice_number of pairs that a person made; they hold whatever the values are.
    A statement line put off, rejected or amended keeps that status whatever it is matched with.
    """
    books, lines = stage(book_side(bills)), stage(statement_side(inward))

    def told(name: str) -> DataFrame:
        return manual.select(*PARTY, F.col("bill_number"), F.col("invoice_number"), F.col(name).alias("raw"))

    ends = told("bill_number").join(books.select(*PARTY, "raw", F.col("id").alias("l")), [*PARTY, "raw"]).drop("raw")
    ends = ends.withColumn("raw", F.col("invoice_number")).join(lines.select(*PARTY, "raw", F.col("id").alias("r")), [*PARTY, "raw"])
    found = stage(mutual_best(ends.select("l", "r"), [F.lit(0)]).withColumn("matched_by", F.lit("manual")))
    for name, keys, order in (("number", [*PARTY, "number"], ["day", "value"]), ("value", [*PARTY, "day", "value", "tax"], ["number"])):
        pairs = rank_pairs(without(books, found, "l"), without(lines, found, "r"), keys, order)
        found = stage(found.unionByName(pairs.withColumn("matched_by", F.lit(name))))
    books_left, lines_left = stage(without(books, found, "l")), stage(without(lines, found, "r"))
    near = _by_value(books_left, lines_left, slack, days).unionByName(_by_number(books_left, lines_left))
    edits = F.levenshtein("number", "r_number")
    points = F.when(_close(slack, days), 2).otherwise(0) + F.when(edits <= 1, 2).otherwise(0)
    chosen = mutual_best(near.select("l", "r", (-points).alias("p"), edits.alias("e"), F.abs(F.datediff("day", "r_day")).alias("g")), [F.col("p"), F.col("e"), F.col("g")])
    found = stage(found.unionByName(chosen.withColumn("matched_by", F.lit("near"))))

    c = F.col
    b = books.select(F.col("id").alias("l"), *[F.col(x).alias(f"b_{x}") for x in (*PARTY, "raw", "day", "value", "tax")])
    g = lines.select(F.col("id").alias("r"), *[F.col(x).alias(f"g_{x}") for x in (*PARTY, "raw", "day", "value", "tax")], "is_amended", "ims_action")
    j = b.join(found, "l", "left").join(g, "r", "full_outer")
    same = (c("b_raw") == c("g_raw")) & (c("b_day") == c("g_day")) & (c("b_value") == c("g_value")) & (c("b_tax") == c("g_tax"))
    close = (F.abs(c("b_value") - c("g_value")) <= slack) & (F.abs(c("b_tax") - c("g_tax")) <= slack) & (F.abs(F.datediff("b_day", "g_day")) <= days)
    status = (
        F.when(c("r").isNull(), "missing_in_2b").when(c("l").isNull(), "missing_in_books").when(c("ims_action") == "pending", "pending")
        .when(c("ims_action") == "reject", "ignored").when(c("is_amended"), "amended").when(c("matched_by") == "manual", "manual_match")
        .when(same, "exact_match").when(close, "suggested_match").otherwise("mismatch"))
    return j.select(
        *[F.coalesce(f"b_{x}", f"g_{x}").alias(x) for x in PARTY], F.col("l").alias("voucher_id"), F.col("b_raw").alias("bill_number"), F.col("g_raw").alias("invoice_number"),
        rupees(c("b_value")).alias("b_taxable"), rupees(c("g_value")).alias("g_taxable"), status.alias("status"), "matched_by")
