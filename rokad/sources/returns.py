"""Government-side and workflow tables: inward statement, audit log, source documents."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.audit import GENESIS, audit_payload
from ..functions.money import MONEY, to_paise
from ..operators.inward import reconcile
from ..operators.staging import stage
from .banking import Banking
from .projection import key_text, pick

SEGMENT_SPAN = 4096
VENDOR_FIRST = ["Shree", "Metro", "Royal", "National", "Global", "Shree", "City"]
VENDOR_SECOND = ["Ram", "Steel", "Paper", "Ram", "Foods"]
VENDOR_KIND = ["Trading Company", "Company", "Trading", "Industries"]


class Tables(Banking):
    @cached_property
    def checked_bills(self) -> DataFrame:
        """What reconciliation and the bill gates read of the bills, staged once: both sides are made from it, and the gates read it again."""
        return stage(self.bills.drop("firm_id", "party_name", "gst_category", "status", "is_rcm", "intra", "round_off", "grand_total", "claim_cgst", "claim_igst",
                                     "itc_blocked", "n_lines"))

    @cached_property
    def gstr_2b(self) -> DataFrame:
        """Inward statement: the suppliers' copy of each bill, some missing, changed, renumbered, misspelt or extra."""
        ok, number, day = F.col("ok"), F.col("bill_number"), F.col("bill_date")
        b = self.checked_bills.filter("supplier_gstin IS NOT NULL AND NOT is_return")
        k = ok % 20
        typed = F.concat(F.lit("1NV"), F.substring(number, 4, 1000))
        base = b.filter(k != 0).select(
            key_text("2B-", F.col("voucher_id")).alias("line_id"), "client_id", "recipient_gstin", "supplier_gstin",
            F.when(k == 2, F.lower(F.replace(number, F.lit("/"), F.lit("-")))).when(k.isin(7, 10), typed).when(k == 8, key_text("N", ok * 7919))
            .when(k == 9, key_text("SUB", ok)).when(k == 11, key_text("Z/", ok)).otherwise(number).alias("invoice_number"),
            F.when(k == 3, F.date_add(day, 2)).when(k == 7, F.date_add(day, 1)).when(k == 8, F.date_sub(day, 3)).when(k == 9, F.date_add(day, 40)).otherwise(day).alias("invoice_date"),
            F.when(k.isin(1, 10), F.col("taxable") + F.lit("100.00").cast(MONEY)).when(k == 8, F.col("taxable") + F.lit("0.40").cast(MONEY)).when(
                k == 9, F.col("taxable") * 2).otherwise(F.col("taxable")).cast(MONEY).alias("taxable"),
            "cgst", "sgst", "igst", (k == 4).alias("is_amended"),
            F.when(k == 5, "pending").when(k == 6, "reject").otherwise("accept").alias("ims_action"))
        extra = b.filter(ok % 25 == 0).select(
            key_text("2X-", F.col("voucher_id")).alias("line_id"), "client_id", "recipient_gstin", "supplier_gstin", F.concat(F.lit("X"), number).alias("invoice_number"),
            day.alias("invoice_date"), "taxable", "cgst", "sgst", "igst", F.lit(False).alias("is_amended"), F.lit("accept").alias("ims_action"))
        return base.unionByName(extra)

    @cached_property
    def manual_pairs(self) -> DataFrame:
        """Pairs of a bill and a statement line that a person made although number, date and value differ."""
        b = self.checked_bills.filter("supplier_gstin IS NOT NULL AND NOT is_return AND ok % 20 = 9")
        return b.select("client_id", "supplier_gstin", "bill_number", key_text("SUB", F.col("ok")).alias("invoice_number"))

    @cached_property
    def reconciled(self) -> DataFrame:
        return reconcile(self.checked_bills, self.gstr_2b, self.manual_pairs)

    def _credit_entries(self, bills: DataFrame, day) -> DataFrame:
        sign = F.when(F.col("is_return"), -1).otherwise(1)
        heads = [F.struct(F.lit(h).alias("head"), (to_paise(F.col(c)) * sign).alias("amount_p")) for h, c in (("cgst", "claim_cgst"), ("sgst", "claim_cgst"), ("igst", "claim_igst"))]
        return bills.select("client_id", day.alias("entry_date"), F.explode(F.array(*heads)).alias("e")).select("client_id", "entry_date", "e.head", "e.amount_p").filter("amount_p <> 0")

    @cached_property
    def own_credit(self) -> DataFrame:
        """Movements of tax credit by head in the client's books."""
        return self._credit_entries(self.bills, F.col("bill_date"))

    @cached_property
    def government_credit(self) -> DataFrame:
        """The same as the government's ledger has it: for three clients of four some bills are absent, late or there twice."""
        k, same = F.col("ok") % 20, F.col("client_id") % 4 == 0
        twice = F.when(~same & (F.col("ok") % 50 == 7), 2).otherwise(1)
        b = self.bills.filter(same | (k != 0)).withColumn("_n", F.explode(F.sequence(F.lit(1), twice)))
        return self._credit_entries(b, F.when(~same & (k == 3), F.date_add("bill_date", 2)).otherwise(F.col("bill_date")))

    @cached_property
    def vendor_master(self) -> DataFrame:
        """Suppliers that each client has bills of, under the names they trade by."""
        k = F.col("sk")
        name = F.concat_ws(" ", pick(VENDOR_FIRST, k % 7, "string"), pick(VENDOR_SECOND, F.floor(k / 7) % 5, "string"), k.cast("string"), pick(VENDOR_KIND, k % 4, "string"))
        own = self.suppliers.select("sk", "party_id", name.alias("party_name"), "gstin")
        return self.bills.select("client_id", "party_id").distinct().join(own, "party_id").select("client_id", "party_id", "party_name", "gstin", "sk")

    @cached_property
    def read_documents(self) -> DataFrame:
        """What was read off each bill: number and name, with a number that is missing or wrong and a name cut, short or another one at times."""
        k, sk = F.col("ok") % 8, F.col("sk")
        b = self.bills.filter("NOT is_return").select("client_id", "party_id", "voucher_id", "ok", "sk")
        b = b.join(self.vendor_master.drop("sk"), ["client_id", "party_id"])
        short = F.upper(F.replace(F.replace("party_name", F.lit("Trading"), F.lit("Trdg")), F.lit("Company"), F.lit("Co.")))
        cut = F.regexp_replace("party_name", " [A-Za-z]+$", "")
        alias = key_text("Shop ", sk * 31)
        name = F.when(k.isin(3, 5), alias).when(k == 4, short).when(k == 6, cut).when(k == 7, key_text("Nowhere Stores ", F.col("ok"))).otherwise(F.col("party_name"))
        number = F.when(k < 4, F.col("gstin")).when(k == 6, F.concat(F.substring("gstin", 1, 14), F.lit("?")))
        return b.select(F.col("voucher_id").alias("document_id"), "client_id", name.alias("name"), number.alias("gstin"))

    @cached_property
    def audit_rows(self) -> DataFrame:
        """Audit rows without hashes. A segment is a firm's bounded run of ids."""
        e, u = F.col("event_id"), F.col("user_id")
        return self.raw("events").select(
            e.alias("id"), (u % 5).cast("int").alias("firm_id"), (u % 25).cast("int").alias("client_id"),
            F.floor(e / SEGMENT_SPAN).cast("int").alias("segment"), F.col("event_type").alias("entity_type"),
            u.alias("entity_id"),
            F.when(e % 4 == 0, "create").when(e % 4 == 1, "update").when(e % 4 == 2, "approve").otherwise("reverse").alias("action"),
            F.lit(None).cast("string").alias("before"), F.col("props").alias("after"), key_text("u", u % 7).alias("actor_user_id"),
            F.when(e % 10 == 0, "ai").when(e % 50 == 1, "support").otherwise("human").alias("actor_type"),
            F.when(e % 10 == 0, "m1").alias("ai_model"), F.when(e % 10 == 0, key_text("u", e % 5)).alias("approved_by"),
            F.col("ts").cast("timestamp").alias("occurred_at"))
