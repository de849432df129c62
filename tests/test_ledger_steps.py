"""The ledger's shared steps: the same figures as from single legs, and few shuffles."""
import inspect
import re
from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from rokad import masters as m
from rokad.operators import matching as mt
from rokad.operators import posting, prefix, tds
from rokad.plans import reports
from rokad.sources.returns import Tables

SMALL = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _big(df):
    """The plan as it is for tables too large to be sent to every task."""
    spark = df.sparkSession
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_sums_of_vouchers_equal_their_legs(spark):
    b = Tables(spark, SMALL)
    vouchers, mirrors = b._document_vouchers()
    p = F.col("signed_paise")
    for span, accounts in (((None, None), None), (("2023-05-03", "2024-02-11"), None), ((None, "2024-02-11"), {m.CASH, m.DEBTORS, m.OUT_IGST})):
        legs = posting.explode_vouchers(b._sales_wide, vouchers, "ok", mirrors, accounts, span)
        want = legs.groupBy("client_id", "account_code", F.trunc("posting_date", "month").alias("period")).agg(
            F.sum(F.greatest(p, F.lit(0))), F.sum(F.greatest(-p, F.lit(0))), F.count(F.lit(1)))
        got = posting.voucher_sums(b._sales_wide, vouchers, mirrors, span, lambda d: F.trunc(d, "month"), accounts)
        assert _rows(got) == _rows(want)


def test_documents_shuffle_no_wide_sums(spark):
    plan = _big(Tables(spark, SMALL).docs)
    moved = re.findall(r"Exchange hashpartitioning\(([a-z_]+)#\d+L?, (?:([a-z_]+)#)?", plan)
    assert [x for x in moved if x[0] == "ok"] == [("ok", ""), ("ok", "")] and "sk" not in [x[0] for x in moved]


def _payments(spark):
    return spark.range(3000).select(
        F.concat(F.lit("V"), "id").alias("voucher_id"), (F.col("id") % 3).cast("int").alias("client_id"), F.concat(F.lit("S"), F.col("id") % 11).alias("party_id"),
        F.lit(2026).alias("fy"), F.date_add(F.lit(date(2026, 4, 1)), (F.col("id") * 7 % 365).cast("int")).alias("payment_date"), (F.col("id") * 977).alias("ok"),
        F.lit(1).cast("long").alias("sk"), F.when(F.col("id") % 13 != 0, "Contractor Payments").alias("tds_category"), F.lit("company").alias("entity_type"),
        (F.col("id") * 7919 % 40000).cast("decimal(18,2)").alias("amount"))


def test_withholding_of_small_keys_shuffles_once_and_equals_the_chunks(spark):
    sections = m.tds_sections(spark)
    plain, cut = (tds.compute(_payments(spark), sections, n) for n in (prefix.HOT_ROWS, 0))
    assert _rows(plain) == _rows(cut) and plain.filter("tds > 0").count() > 0
    assert _big(plain).count("Exchange hashpartitioning(client_id") == 1


def test_allocation_of_small_parties_equals_the_chunks(spark):
    p = _payments(spark).filter("amount > 0")
    r = p.filter("ok % 2 = 0").select("client_id", "party_id", F.col("voucher_id").alias("receipt_id"), F.col("payment_date").alias("receipt_date"), "amount", "ok", "sk")
    d = p.filter("ok % 2 = 1").select("client_id", "party_id", "voucher_id", F.col("payment_date").alias("document_date"), F.col("amount").alias("due"), "ok", "sk")
    small, cut = mt.allocate(r, d), mt.allocate(r, d, 0)
    assert _rows(small) == _rows(cut) and small.count() > 1000
    assert _big(small).count("Exchange hashpartitioning(client_id") == 1


def test_accounts_of_a_voucher_are_found_without_moving_legs(spark):
    documents, payments = Tables(spark, SMALL).voucher_accounts()
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", _big(documents))
    assert moved and not [x for x in moved if "voucher_id" in x]
    # a payment is moved as two numbers, not as legs
    assert "Exchange hashpartitioning(voucher_id" in _big(payments) and "posexplode" not in _big(payments)
    one = {r["voucher_id"]: r for r in documents.union(payments).filter("voucher_id LIKE 'RC-%' OR voucher_id LIKE 'PY-%'").limit(2000).collect()}
    assert one and all(r["credit_accounts"] and r["debit_accounts"] for r in one.values())


def test_ledger_day_is_one_chunk_and_equals_a_plain_sum(spark):
    rows = spark.range(400).select(
        F.lit(1).alias("client_id"), F.lit(1001).alias("account_code"), (F.col("id") * 2500).alias("doc_key"), F.date_add(F.lit(date(2025, 4, 1)), (F.col("id") % 5).cast("int")).alias("posting_date"),
        F.concat(F.lit("V"), "id").alias("voucher_id"), F.lit("sales").alias("voucher_type"), F.lit(None).cast("string").alias("party_id"), ((F.col("id") % 7 - 3) * 100).alias("signed_paise"))
    before = spark.createDataFrame([(1, 1001, D("5.00"))], "client_id int, account_code int, opening_balance decimal(18,2)")
    total, want = 0, {}
    for r in sorted(rows.collect(), key=lambda r: (r["posting_date"], r["doc_key"])):
        total += r["signed_paise"]
        want[r["voucher_id"]] = D(total) / 100
    for span in (1 << 20, 1000):
        got = reports.account_ledger_of(rows, before, span).collect()
        assert {r["voucher_id"]: r["running_balance"] for r in got} == want
    assert inspect.signature(reports.account_ledger).parameters["id_span"].default >= 1 << 20
