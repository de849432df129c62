"""Tax returns and credit reconciliation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import masters as m
from ..functions import dates
from ..functions.money import MONEY, nonnull, rupees, to_paise, zero
from ..operators.effective import threshold_on
from ..operators.prefix import running_sum
from ..operators.staging import stage


def period(date: str) -> Column:
    return F.date_format(date, "yyyy-MM")


def bucket(sales: DataFrame) -> DataFrame:
    """Return table of every document."""
    c = F.col
    registered = ~c("gst_category").isin("unregistered", "overseas")
    limit = threshold_on(m.THRESHOLDS, "b2cl_value", c("posting_date"))
    name = (
        F.when(c("is_return"), F.when(registered, "CDNR").otherwise("CDNUR"))
        .when(c("is_export"), F.when(c("export_type") == "with_payment", "EXPWP").otherwise("EXPWOP"))
        .when(c("gst_category") == "sez", "SEZ").when(registered, "B2B")
        .when(~c("intra") & (c("grand_total") > limit), "B2CL").otherwise("B2CS"))
    return sales.select("*", period("posting_date").alias("period"), name.alias("bucket"))


def invoice_wise(bucketed: DataFrame, buckets: list[str]) -> DataFrame:
    return bucketed.filter(F.col("bucket").isin(buckets)).select(
        "client_id", "period", "bucket", "voucher_id", "party_gstin", "place_of_supply", "taxable", "cgst", "sgst", "igst",
        "cess", "grand_total")


def _heads() -> list[Column]:
    return [F.sum(h).cast(MONEY).alias(h) for h in ("taxable", "cgst", "sgst", "igst", "cess")]


def b2cs(lines: DataFrame, bucketed: DataFrame) -> DataFrame:
    """Consumer supplies consolidated by place of supply and rate."""
    keep = bucketed.filter("bucket = 'B2CS'").select("voucher_id", "period")
    return lines.filter("treatment = 'taxable'").join(keep, "voucher_id").groupBy(
        "client_id", "period", "place_of_supply", "gst_rate").agg(*_heads())


def hsn_summary(lines: DataFrame) -> DataFrame:
    sign = F.when(F.col("is_return"), -1).otherwise(1)
    return lines.groupBy("client_id", period("posting_date").alias("period"), "hsn", "uom", "gst_rate").agg(
        F.sum(F.col("units") * sign).cast("decimal(28,3)").alias("quantity"),
        *[F.sum(F.col(h) * sign).cast(MONEY).alias(h) for h in ("taxable", "cgst", "sgst", "igst", "cess")])


def nil_supplies(lines: DataFrame) -> DataFrame:
    """Nil-rated, exempt and non-GST supplies by kind of customer."""
    inter = F.when(F.col("intra"), "intra").otherwise("inter")
    registered = F.when(F.col("gst_category").isin("unregistered", "overseas"), "unregistered").otherwise("registered")
    return lines.filter(F.col("treatment").isin("nil_rated", "exempt", "non_gst") & ~F.col("is_return")).groupBy(
        "client_id", period("posting_date").alias("period"), inter.alias("supply"), registered.alias("customer"), "treatment"
    ).agg(F.sum("taxable").cast(MONEY).alias("taxable"))


def output_tax(sales: DataFrame) -> DataFrame:
    sign = F.when(F.col("is_return"), -1).otherwise(1)
    own = F.when(F.col("is_rcm"), F.lit(0)).otherwise(sign)
    return sales.groupBy("client_id", period("posting_date").alias("period")).agg(
        F.sum(F.col("taxable") * sign).cast(MONEY).alias("out_taxable"),
        *[F.sum(F.col(h) * own).cast(MONEY).alias(f"out_{h}") for h in ("cgst", "sgst", "igst", "cess")],
        nonnull(F.sum(F.when(F.col("is_export"), F.col("taxable") * sign))).alias("zero_rated"),
        nonnull(F.sum(F.when(~F.col("intra") & (F.col("gst_category") == "unregistered"), F.col("taxable") * sign))).alias(
            "inter_unregistered"))


def input_tax(bills: DataFrame) -> DataFrame:
    sign = F.when(F.col("is_return"), -1).otherwise(1)
    rcm = F.when(F.col("is_rcm"), sign).otherwise(0)
    return bills.groupBy("client_id", period("bill_date").alias("period")).agg(
        F.sum(F.col("claim_cgst") * sign).cast(MONEY).alias("itc_cgst"),
        F.sum(F.col("claim_cgst") * sign).cast(MONEY).alias("itc_sgst"),
        F.sum(F.col("claim_igst") * sign).cast(MONEY).alias("itc_igst"),
        F.sum(F.col("itc_blocked") * sign).cast(MONEY).alias("itc_blocked"),
        *[F.sum(F.col(h) * rcm).cast(MONEY).alias(f"rcm_{h}") for h in ("cgst", "sgst", "igst")])


def summary_return(sales: DataFrame, bills: DataFrame) -> DataFrame:
    """Outward supplies, reverse-charge liability and credit per client and month."""
    j = output_tax(sales).join(input_tax(bills), ["client_id", "period"], "full_outer")
    return j.select("client_id", "period", *[nonnull(F.col(c)).alias(c) for c in j.columns if c not in ("client_id", "period")])


HEADS = ("igst", "cgst", "sgst")
#: Credit head -> tax head, in the prescribed order; central and state credit never pay each other.
USES = (("igst", "igst"), ("igst", "cgst"), ("igst", "sgst"), ("cgst", "cgst"), ("cgst", "igst"), ("sgst", "sgst"), ("sgst", "igst"))


def set_off(summary: DataFrame) -> DataFrame:
    """Credit used in the prescribed order, month after month of each client; the rest is cash.

    Unused credit goes to the next month, and so does a negative liability (more credit notes than sales) or negative credit.
    Reverse-charge tax is paid in cash. A client has one row per month, so its months are one small sequential group.
    """
    c = F.col
    names = [*[f"use_{a}_{b}" for a, b in USES], *[f"cash_{h}" for h in HEADS], "cash_rcm", *[f"left_{h}" for h in HEADS]]
    df = summary.select(
        "client_id", "period", *[to_paise(c(f"out_{h}")).alias(f"out_{h}") for h in HEADS], *[to_paise(c(f"itc_{h}")).alias(f"itc_{h}") for h in HEADS],
        to_paise(F.greatest(c("rcm_cgst") + c("rcm_sgst") + c("rcm_igst"), zero())).alias("cash_rcm"))

    def months(pdf):
        pdf = pdf.sort_values("period")
        owed, held = dict.fromkeys(HEADS, 0), dict.fromkeys(HEADS, 0)
        rows = []
        for row in pdf.itertuples(index=False):
            liability = {h: int(getattr(row, f"out_{h}")) + owed[h] for h in HEADS}
            credit = {h: int(getattr(row, f"itc_{h}")) + held[h] for h in HEADS}
            due, left = {h: max(liability[h], 0) for h in HEADS}, {h: max(credit[h], 0) for h in HEADS}
            used = []
            for source, target in USES:
                amount = min(left[source], due[target])
                left[source] -= amount
                due[target] -= amount
                used.append(amount)
            owed = {h: min(liability[h], 0) for h in HEADS}
            held = {h: left[h] + min(credit[h], 0) for h in HEADS}
            rows.append((*used, *due.values(), int(row.cash_rcm), *left.values()))
        out = pdf[["client_id", "period"]].copy()
        for name, column in zip(names, zip(*rows, strict=True), strict=True):
            out[name] = column
        return out

    schema = summary.select("client_id", "period").schema
    for name in names:
        schema = type(schema)([*schema.fields]).add(name, "long")
    paid = df.groupBy("client_id").applyInPandas(months, schema)
    return paid.select("client_id", "period", *[rupees(c(n)).alias(n) for n in names])


def ledger_divergence(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Where two books of the same client and head part: the first date with a gap between their balances, that gap, and what is left of it.

    Both sides have client_id, head, entry_date, amount_p (signed paise). The gap on a date is the running sum of the days' differences. Days on which both
    moved alike are no rows of it, so books that agree leave nothing to carry.
    """
    keys = ["client_id", "head"]
    both = ours.select(*keys, "entry_date", F.col("amount_p").alias("o"), F.lit(0).cast("long").alias("t")).unionByName(
        theirs.select(*keys, "entry_date", F.lit(0).cast("long").alias("o"), F.col("amount_p").alias("t")))
    days = stage(both.groupBy(*keys, "entry_date").agg(F.sum("o").alias("o"), F.sum("t").alias("t")))
    balances = days.groupBy(*keys).agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
    moved = days.filter("o <> t").withColumn("_month", F.trunc("entry_date", "month")).withColumn("_d", F.col("o") - F.col("t"))
    gap = running_sum(moved, keys, ["_month"], ["entry_date"], {"gap": F.col("_d")}, "long")
    apart = gap.filter("gap <> 0").groupBy(*keys).agg(F.min(F.struct("entry_date", "gap")).alias("first"), F.max("entry_date").alias("last_apart"))
    status = F.when(F.col("first").isNull(), "equal").when(F.col("o") == F.col("t"), "met_again").otherwise("apart")
    return balances.join(apart, keys, "left").select(
        *keys, rupees(F.col("o")).alias("own_balance"), rupees(F.col("t")).alias("other_balance"), F.col("first.entry_date").alias("first_apart"),
        rupees(F.col("first.gap")).alias("first_gap"), rupees(F.col("o") - F.col("t")).alias("closing_gap"), status.alias("status"))
