"""Tax jobs: scalar checks, credit, withholding, returns."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import masters as m
from ..functions import dates, gstin
from ..functions import tax as tx
from ..functions.money import MONEY, nonnull, pct, zero
from ..operators import itc
from ..operators.effective import resolve_gst_rate, threshold_on
from . import returns as r
from .registry import job

AS_OF = "2027-03-31"


@job("line_tax")
def line_tax(b):
    return b.sales_lines.select("voucher_id", "pk", "line_number", "units", "unit_price", "discount", "gst_rate", "treatment",
                                "taxable", "cgst", "sgst", "igst", "cess")


@job("invoice_totals")
def invoice_totals(b):
    return b.sales.select("voucher_id", "taxable", "cgst", "sgst", "igst", "cess", "round_off", "grand_total", "intra", "n_lines")


@job("verify_tax")
def verify_tax(b):
    """Bills whose stated tax differs from the recomputed one."""
    c = F.col
    return b.bills.filter((c("stated_cgst") != c("cgst")) | (c("stated_igst") != c("igst"))).select(
        "voucher_id", "bill_number", "cgst", "igst", "stated_cgst", "stated_igst")


@job("gstin_check")
def gstin_check(b):
    g = F.col("gstin")
    why = gstin.gstin_reason(g)
    ok = why.isNull()
    return b.parties.select("party_id", "gstin", why.alias("reason"), F.when(ok, gstin.state_of(g)).alias("state"),
                            F.when(ok, gstin.pan_of(g)).alias("pan"), gstin.pan_valid(gstin.pan_of(g)).alias("pan_valid"))


@job("resolve_gst_rate")
def resolve_rate(b):
    """Stated line rates against the master row in force."""
    j = resolve_gst_rate(b.sales_lines, m.gst_rates(b.spark), "hsn", "posting_date")
    return j.groupBy("hsn", "gst_rate", "master_rate_id", "master_gst_rate").agg(F.count(F.lit(1)).alias("lines"))


@job("resolve_threshold")
def resolve_threshold(b):
    return b.sales.select("voucher_id", threshold_on(m.THRESHOLDS, "b2cl_value", F.col("posting_date")).alias("b2cl_value"))


@job("resolve_period")
def resolve_period(b):
    """Documents per fiscal year and period, with the closed flag of the period."""
    from ..operators.effective import resolve_period as rp
    closed = b.sales.filter("ok % 50 = 0").select("client_id", dates.month_start(F.col("posting_date")).alias("period_start")).distinct()
    j = rp(b.sales, closed, "posting_date")
    return j.groupBy("client_id", dates.fy_label(F.col("fy")).alias("fy"), "period_start", "period_closed").agg(
        F.count(F.lit(1)).alias("documents"))


@job("tds_computation")
def tds_computation(b):
    return b.tds.select("voucher_id", "section_id", "amount", "cumulative_after", "taxable_base", "tds", "threshold_crossed").filter(
        "section_id IS NOT NULL")


@job("tds_quarterly")
def tds_quarterly(b):
    q = F.concat(F.year("payment_date").cast("string"), F.lit("-Q"), F.quarter("payment_date").cast("string"))
    return b.tds.filter("tds > 0").groupBy("client_id", q.alias("quarter"), "party_id", "section_id").agg(
        F.sum("amount").cast(MONEY).alias("paid"), F.sum("tds").cast(MONEY).alias("withheld"), F.count(F.lit(1)).alias("payments"))


@job("tds_recon")
def tds_recon(b):
    """Withheld per payments against the payable account of the ledger, by month."""
    p = b.tds.groupBy("client_id", r.period("payment_date").alias("period")).agg(F.sum("tds").cast(MONEY).alias("withheld"))
    led = b.payment_legs.filter(F.col("account_code") == m.TDS_PAYABLE).groupBy(
        "client_id", r.period("posting_date").alias("period")).agg(F.sum("credit").cast(MONEY).alias("booked"))
    return p.join(led, ["client_id", "period"], "full_outer").select(
        "client_id", "period", nonnull(F.col("withheld")).alias("withheld"), nonnull(F.col("booked")).alias("booked"),
        (nonnull(F.col("withheld")) == nonnull(F.col("booked"))).alias("agrees")).filter("withheld <> 0 OR booked <> 0")


@job("bill_itc_header")
def bill_itc_header(b):
    return b.bills.select("voucher_id", "itc_eligibility", "itc_claimable", "itc_blocked", "claim_cgst", "claim_igst")


@job("itc_decide")
def itc_decide(b):
    """Decision and amount per client and expense account."""
    from ..sources.projection import EXPENSE_ACCOUNTS
    rules = {a: (rule, cat) for a, rule, cat in m.ITC_RULES}
    acc = F.col("expense_account")
    declared = category = F.lit(None).cast("string")
    for a in EXPENSE_ACCOUNTS:
        if a in rules:
            declared = F.when(acc == a, rules[a][0]).otherwise(declared)
            category = F.when(acc == a, rules[a][1]).otherwise(category)
    g = b.lines.join(b.orders.select("ok", "buyer", "buyer_trade"), "ok").groupBy(
        F.col("buyer").alias("client_id"), "buyer_trade", "expense_account").agg(F.count(F.lit(1)).alias("lines"))
    return g.select("client_id", "expense_account", "lines", itc.decide(declared, category, F.col("buyer_trade")).alias("eligibility"),
                    itc.reason(declared, category, F.col("buyer_trade")).alias("reason"))


@job("recon_2b")
def recon_2b(b):
    return b.reconciled


@job("ledger_divergence")
def ledger_divergence(b):
    """Tax credit in the books against the government's ledger, per client and head."""
    return r.ledger_divergence(b.own_credit, b.government_credit)


@job("resolve_vendor")
def resolve_vendor(b):
    """Vendor of every bill from the number and the name read off it."""
    from ..operators import vendor
    return vendor.resolve_vendor(b.read_documents, b.vendor_master.drop("sk"))


@job("itc_claimable")
def itc_claimable(b):
    """May the credit of each bill be claimed; late filers are overridden on every fortieth order."""
    s = b.reconciled.filter("voucher_id IS NOT NULL").select("voucher_id", "status")
    j = b.checked_bills.filter("NOT is_return").join(s, "voucher_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("missing_in_2b")))
    over = F.when(F.col("ok") % 40 == 0, F.lit("supplier filed late"))
    e = F.col("itc_eligibility")
    return j.select("voucher_id", "status", itc.claimable(e, F.col("status"), over).alias("claimable"),
                    itc.claim_reason(e, F.col("status"), over).alias("reason"))


@job("itc_180_day")
def itc_180_day(b):
    paid = b.payments.groupBy("settles_voucher_id").agg(F.sum("amount").cast(MONEY).alias("settled_debit"))
    return itc.approaching_180_days(b.bills.filter("NOT is_return"), paid, "2026-12-31")


@job("itc_anomalies")
def itc_anomalies(b):
    """Months whose credit is 30 % above the average of the six before, per client."""
    i = r.input_tax(b.bills).withColumn("claim", (F.col("itc_cgst") + F.col("itc_sgst") + F.col("itc_igst")).cast(MONEY))
    w = W.partitionBy("client_id").orderBy("period").rowsBetween(-6, -1)
    i = i.withColumn("_sum", F.sum("claim").over(w)).withColumn("_n", F.count("claim").over(w))
    return i.filter((F.col("_n") > 0) & (F.col("claim") * F.col("_n") * 10 > F.col("_sum") * 13)).select(
        "client_id", "period", "claim", F.col("_n").alias("months"))


@job("suppliers_never_in_2b")
def suppliers_never_in_2b(b):
    return b.checked_bills.filter("supplier_gstin IS NOT NULL").select("client_id", "supplier_gstin").distinct().join(
        b.gstr_2b.select("client_id", "supplier_gstin"), ["client_id", "supplier_gstin"], "left_anti")


@job("claim_deadline")
def claim_deadline(b):
    """Unclaimed credit per fiscal year with the last day to claim it: 30 November after the year end."""
    fy = dates.fy_start(F.col("bill_date"))
    last = F.make_date(fy + 1, F.lit(11), F.lit(30))
    return b.bills.filter("NOT is_return AND approval_status = 'pending_review'").groupBy(
        "client_id", dates.fy_label(fy).alias("fy"), last.alias("deadline")).agg(
        F.sum("itc_claimable").cast(MONEY).alias("unclaimed"), F.count(F.lit(1)).alias("bills")).withColumn(
        "days_left", F.datediff("deadline", F.lit(AS_OF).cast("date")))


@job("gstr1_bucket")
def gstr1_bucket(b):
    return r.bucket(b.sales).select("voucher_id", "period", "bucket")


@job("gstr1_b2b")
def gstr1_b2b(b):
    return r.invoice_wise(r.bucket(b.sales), ["B2B", "SEZ", "B2CL"])


@job("gstr1_cdn")
def gstr1_cdn(b):
    return r.invoice_wise(r.bucket(b.sales), ["CDNR", "CDNUR"])


@job("gstr1_exp")
def gstr1_exp(b):
    return r.invoice_wise(r.bucket(b.sales), ["EXPWP", "EXPWOP"])


@job("gstr1_b2cs")
def gstr1_b2cs(b):
    return r.b2cs(b.sales_lines, r.bucket(b.sales))


@job("gstr1_hsn")
def gstr1_hsn(b):
    return r.hsn_summary(b.sales_lines)


@job("gstr1_nil")
def gstr1_nil(b):
    return r.nil_supplies(b.sales_lines)


@job("gstr3b")
def gstr3b(b):
    return r.summary_return(b.sales, b.bills)


@job("itc_set_off")
def itc_set_off(b):
    return r.set_off(r.summary_return(b.sales, b.bills))


@job("net_gst_payable")
def net_gst_payable(b):
    c = F.col
    return r.summary_return(b.sales, b.bills).select(
        "client_id", "period", (c("out_cgst") + c("out_sgst") + c("out_igst")).cast(MONEY).alias("output_tax"),
        (c("itc_cgst") + c("itc_sgst") + c("itc_igst")).cast(MONEY).alias("input_tax"),
        (c("out_cgst") + c("out_sgst") + c("out_igst") - c("itc_cgst") - c("itc_sgst") - c("itc_igst")).cast(MONEY).alias("net"))


def _due(b):
    """Due date of each client-month: the 20th of the next month; quarterly filers on the 22nd after the quarter."""
    d = F.col("period_start")
    month = F.add_months(d, 1)
    quarter_end = F.add_months(F.trunc(d, "quarter"), 3)
    base = b.sales.groupBy("client_id", dates.month_start(F.col("posting_date")).alias("period_start")).agg(
        F.sum("grand_total").cast(MONEY).alias("turnover"), F.max("posting_date").alias("last_document"))
    quarterly = F.col("client_id") % 2 == 1
    return base.select("*", quarterly.alias("quarterly"), F.when(quarterly, F.date_add(quarter_end, 21)).otherwise(
        F.date_add(month, 19)).alias("summary_due"), F.when(quarterly, F.date_add(quarter_end, 12)).otherwise(
        F.date_add(month, 10)).alias("outward_due"))


@job("compliance_calendar")
def compliance_calendar(b):
    """Return × period rows for every client-month with activity, with the three alert days."""
    df = _due(b).select("client_id", "period_start", F.explode(F.array(
        F.struct(F.lit("GSTR-1").alias("return_name"), F.col("outward_due").alias("due")),
        F.struct(F.lit("GSTR-3B").alias("return_name"), F.col("summary_due").alias("due")))).alias("x"))
    return df.select("client_id", "period_start", "x.return_name", "x.due", F.date_sub("x.due", 7).alias("alert_7"),
                     F.date_sub("x.due", 3).alias("alert_3"), F.date_sub("x.due", 1).alias("alert_1"))


@job("late_charges")
def late_charges(b):
    """Interest at 18 % a year and ₹50 a day (capped) on summaries filed late; filing lags vary by client and month."""
    s = r.set_off(r.summary_return(b.sales, b.bills))
    cash = (F.col("cash_igst") + F.col("cash_cgst") + F.col("cash_sgst") + F.col("cash_rcm")).cast(MONEY)
    d = _due(b).withColumn("period", F.date_format("period_start", "yyyy-MM")).withColumn(
        "late_days", (F.col("client_id") * 7 + F.month("period_start")) % 12)
    j = s.withColumn("cash", cash).join(d.select("client_id", "period", "late_days"), ["client_id", "period"])
    interest = F.round(F.col("cash") * 18 * F.col("late_days") * F.lit("0.01").cast("decimal(3,2)") / 365, 2).cast(MONEY)
    return j.filter("late_days > 0").select("client_id", "period", "cash", "late_days", interest.alias("interest"),
                                            F.least(F.col("late_days") * 50, F.lit(10000)).cast(MONEY).alias("late_fee"))


@job("validate_returns")
def validate_returns(b):
    """Pre-filing checks: documents counted once, table totals against the books, periods with blank codes."""
    bk = r.bucket(b.sales)
    g = bk.groupBy("client_id", "period").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("voucher_id").alias("distinct_documents"),
                                              F.sum("taxable").cast(MONEY).alias("header_taxable"))
    li = b.sales_lines.groupBy("client_id", r.period("posting_date").alias("period")).agg(
        F.sum("taxable").cast(MONEY).alias("line_taxable"), F.count_if(F.coalesce("hsn", F.lit("")) == "").alias("blank_hsn"),
        F.count_if((F.col("cgst") + F.col("sgst") > 0) & (F.col("igst") > 0)).alias("both_heads"))
    c = F.col
    return g.join(li, ["client_id", "period"]).select(
        "client_id", "period", "documents", (c("documents") == c("distinct_documents")).alias("gv_1"),
        (c("header_taxable") == c("line_taxable")).alias("gv_2"), (c("blank_hsn") == 0).alias("gv_4"), (c("both_heads") == 0).alias("gv_6"))
