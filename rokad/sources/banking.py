"""Bank-side domain tables: lines, statements, matches, cheques, learned rules."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.money import MONEY, zero
from ..operators.prefix import running_sum_by_size
from ..operators.staging import stage
from .projection import Books, key_text, padded

LINE_SPAN = 65536
LINE = ["client_id", "account_id", "line_id", "line_key", "txn_date", "narration", "debit", "credit", "source",
        "is_ignored"]


def narration(e: Column, u: Column) -> Column:
    k = e % 11
    return (
        F.when(k == 0, key_text("UPI/", padded(e, 12), "/Payment from/user", u, "@okbank/UPI"))
        .when(k == 1, key_text("UPI-XXXXXXX7140-SBIN0000641-", padded(e, 12)))
        .when(k == 2, key_text("NEFT-UTIB", padded(e, 12), "-Customer#", padded(u, 9)))
        .when(k == 3, key_text("RTGS-HDFCR", padded(e, 11), "-Supplier#", padded(u, 9)))
        .when(k == 4, key_text("IMPS/P2A/", padded(e, 12), "/RAMESH KUMAR/HDFC"))
        .when(k == 5, key_text("CHQ PAID 0", padded(e % 100000, 5)))
        .when(k == 6, key_text("ACH C- EXAMPLE COMPANY-", padded(e, 8)))
        .when(k == 7, key_text("ATM WDL ", padded(e % 10000, 4), "  MAIN  ROAD"))
        .when(k == 8, F.lit("BY CASH DEPOSIT"))
        .when(k == 9, F.lit("INT.PD:01-04-2026 TO 30-06-2026"))
        .otherwise(F.when(e % 22 == 10, F.lit("SMS CHARGES QTR")).otherwise(key_text("MISC ADJ ", e))))


class Banking(Books):
    @cached_property
    def event_lines(self) -> DataFrame:
        """Statement lines of every account, one per event."""
        e, u = F.col("event_id"), F.col("user_id")
        amount = F.col("value").cast(MONEY)
        inflow = F.col("event_type").isin("purchase", "signup")
        return self.raw("events").select(
            (u % 25).cast("int").alias("client_id"), u.alias("account_id"), key_text("E", e).alias("line_id"),
            e.alias("line_key"), F.col("ts").cast("date").alias("txn_date"), narration(e, u).alias("narration"),
            F.when(inflow, zero()).otherwise(amount).alias("debit"),
            F.when(inflow, amount).otherwise(zero()).alias("credit"), F.lit("statement").alias("source"),
            (e % 101 == 0).alias("is_ignored"))

    @cached_property
    def collection_lines(self) -> DataFrame:
        """Credits that have arrived for invoices still open in the books."""
        ok = F.col("ok")
        s = self.sales.filter(~F.col("is_return") & ~F.col("is_reversed") & (F.col("status") == "O") & ok.__mod__(4).isin(1, 2))
        tds = F.round(F.col("taxable") * F.lit("0.10").cast("decimal(3,2)"), 2).cast(MONEY)
        amount = F.when(ok % 5 == 0, F.floor(F.col("grand_total") * F.lit("0.50").cast("decimal(3,2)"), 2)).when(
            ok % 3 == 0, F.col("grand_total") - tds).otherwise(F.col("grand_total")).cast(MONEY)
        return s.filter(amount > 0).select(
            "client_id", F.col("client_id").cast("long").alias("account_id"),
            key_text("K", ok, "-", F.col("sk")).alias("line_id"), ok.alias("line_key"),
            F.date_add("posting_date", (ok % 40 + 1).cast("int")).alias("txn_date"),
            key_text("NEFT-REFN", padded(ok, 12), "-", F.col("party_name")).alias("narration"),
            zero().alias("debit"), amount.alias("credit"),
            F.when(ok % 8 == 2, "collection").otherwise("statement").alias("source"), F.lit(False).alias("is_ignored"))

    @cached_property
    def account_credits(self) -> DataFrame:
        """Credits of the bank's own feed: settlements of one to three days' collections, some short of a fee or absent, and other payments."""
        days = 1 + F.col("client_id") % 3
        number = F.floor(F.datediff("txn_date", F.lit("2000-01-01").cast("date")) / days)
        c = self.collection_lines.withColumn("_n", number)
        n = F.col("client_id") + F.col("_n")
        bulk = c.filter("source = 'collection'").groupBy("client_id", "account_id", "_n").agg(F.sum("credit").alias("_s"), F.max("txn_date").alias("_d")).filter(n % 11 != 0)
        fee = F.when(n % 7 == 0, F.lit("1.00")).otherwise(F.lit("0.00")).cast(MONEY)
        settled = bulk.select("client_id", "account_id", key_text("B", F.col("client_id"), "-", F.col("_n")).alias("line_id"), F.date_add("_d", (1 + n % 2).cast("int")).alias("txn_date"),
                              (F.col("_s") - fee).cast(MONEY).alias("credit"))
        return settled.unionByName(c.filter("source = 'statement'").select("client_id", "account_id", "line_id", "txn_date", "credit"))

    @cached_property
    def outflow_lines(self) -> DataFrame:
        """Debits paid against bills still open in the books."""
        ok = F.col("ok")
        b = self.bills.filter(~F.col("is_return") & (F.col("status") == "O") & (ok % 4 == 3) & (F.col("grand_total") > 0))
        return b.select(
            "client_id", F.col("client_id").cast("long").alias("account_id"),
            key_text("P", ok, "-", F.col("sk")).alias("line_id"), ok.alias("line_key"),
            F.date_add("bill_date", (ok % 40).cast("int")).alias("txn_date"),
            key_text("RTGS-SBINR", padded(ok, 12), "-", F.col("party_name")).alias("narration"),
            F.col("grand_total").alias("debit"), zero().alias("credit"), F.lit("statement").alias("source"),
            F.lit(False).alias("is_ignored"))

    @cached_property
    def document_bank_lines(self) -> DataFrame:
        return self.collection_lines.unionByName(self.outflow_lines)

    @cached_property
    def bank_lines(self) -> DataFrame:
        return self.event_lines.unionByName(self.document_bank_lines)

    def parsed(self, lines: DataFrame) -> DataFrame:
        df = lines.withColumn("rule", text.narration_rule(F.col("narration")))
        p = text.parse_narration(F.col("narration"), F.col("rule"))
        return df.select("*", *[c.alias(n) for n, c in p.items()])

    @cached_property
    def stated_lines(self) -> DataFrame:
        """Event lines with week statement and the running balance printed on them; staged, as statements and lines both read it."""
        e = F.col("line_key")
        week = F.floor(F.datediff("txn_date", F.lit("2024-01-01").cast("date")) / 7).cast("int")
        df = self.event_lines.select("*", week.alias("week"), F.floor(e / LINE_SPAN).alias("_chunk"))
        run = running_sum_by_size(df, ["account_id"], ["txn_date", "_chunk"], ["txn_date", "line_key"],
                          {"true_balance": F.col("credit") - F.col("debit")})
        opening = F.lit("1000.00").cast(MONEY)
        true = (F.col("true_balance") + opening).cast(MONEY)
        stated = F.when(e % 13 == 0, F.lit(None)).when(e % 997 == 0, true + F.lit("0.50").cast(MONEY)).otherwise(true)
        return stage(run.select(
            "client_id", "account_id", "week", "line_id", "line_key", "txn_date", "narration", "debit", "credit",
            true.alias("true_balance"), stated.cast(MONEY).alias("running_balance"), "_chunk"))

    @cached_property
    def statements(self) -> DataFrame:
        """One statement per account and week; one in fifty declares a wrong closing balance."""
        first = F.min_by(F.col("true_balance") - F.col("credit") + F.col("debit"), F.struct("txn_date", "line_key"))
        last = F.max_by("true_balance", F.struct("txn_date", "line_key"))
        g = self.stated_lines.groupBy("client_id", "account_id", "week").agg(
            first.cast(MONEY).alias("opening_balance"), last.alias("_close"), F.count(F.lit(1)).alias("row_count"),
            F.min("txn_date").alias("period_from"), F.max("txn_date").alias("period_to"))
        wrong = (F.col("account_id") + F.col("week")) % 50 == 0
        return g.select(
            "client_id", "account_id", "week", "period_from", "period_to", "opening_balance", "row_count",
            F.when(wrong, F.col("_close") + F.lit("10.00").cast(MONEY)).otherwise(F.col("_close")).cast(MONEY).alias(
                "closing_balance"))

    @cached_property
    def matches(self) -> DataFrame:
        """Allocations of event lines to vouchers, some undone, over-allocated or of another client."""
        e = F.col("line_key")
        amount = F.col("debit") + F.col("credit")
        part = F.when(e % 9 == 6, F.floor(amount * F.lit("0.50").cast("decimal(3,2)"), 2)).when(
            e % 41 == 0, amount + F.lit("100.00").cast(MONEY)).otherwise(amount).cast(MONEY)
        return self.event_lines.filter(e % 3 == 0).select(
            key_text("M", e).alias("match_id"), "line_id", "account_id",
            F.when(e % 47 == 0, (F.col("client_id") + 1) % 25).otherwise(F.col("client_id")).alias("client_id"),
            part.alias("amount"),
            F.when(e % 2 == 0, "ai_proposed").when(e % 5 == 0, "scored").otherwise("manual").alias("match_type"),
            F.when(e % 30 == 0, F.lit(None)).otherwise(key_text("u", e % 7)).alias("approved_by"),
            (e % 60 == 3).alias("ambiguous"), F.col("txn_date").alias("created_on"),
            F.when(e % 27 == 0, F.date_add("txn_date", 5)).alias("unmatched_on"))

    @cached_property
    def cheques(self) -> DataFrame:
        """Cheques received from customers and issued to suppliers."""
        ok = F.col("ok")
        r = self.receipts.filter(ok % 9 == 0).select(
            "firm_id", "client_id", "voucher_id", "party_id", "ok", "sk", F.lit("received").alias("direction"),
            F.col("receipt_date").alias("cheque_date"), F.col("cash").alias("amount"))
        p = self.payments.filter(ok % 9 == 1).select(
            "firm_id", "client_id", "voucher_id", "party_id", "ok", "sk", F.lit("issued").alias("direction"),
            F.col("payment_date").alias("cheque_date"), "amount")
        k = ok % 4
        return r.unionByName(p).select(
            "*", padded(ok % 1000000, 6).alias("cheque_number"), F.col("client_id").cast("long").alias("account_id"),
            F.when(k == 1, "cleared").when(k == 2, "bounced").otherwise("pending").alias("status"),
            F.when(k == 1, F.date_add("cheque_date", (ok % 20).cast("int"))).alias("cleared_date"),
            F.when(k == 2, F.date_add("cheque_date", (ok % 10 + 3).cast("int"))).alias("bounced_date"))
