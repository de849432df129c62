"""Worked figures for the scalar functions."""
from decimal import Decimal as D

from pyspark.sql import functions as F

from rokad.functions import dates, gstin, tax, text


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_line_tax_and_truncation(spark):
    t = tax.line_tax(F.lit("10000").cast("decimal(18,2)"), F.lit("18").cast("decimal(5,2)"), F.lit(0), F.lit("taxable"), F.lit(True))
    x = tax.line_tax(F.lit("10000").cast("decimal(18,2)"), F.lit("18").cast("decimal(5,2)"), F.lit(0), F.lit("taxable"), F.lit(False))
    q = tax.line_tax(F.lit("10000").cast("decimal(18,2)"), F.lit("0.25").cast("decimal(5,2)"), F.lit(0), F.lit("taxable"), F.lit(True))
    g = tax.taxable_value(F.lit("1.005"), F.lit("99.999"), F.lit("0"))
    r = one(spark, t["cgst"], t["sgst"], x["igst"], q["cgst"], g, tax.round_off(F.lit("1179.99").cast("decimal(18,2)")))
    assert tuple(r) == (D("900.00"), D("900.00"), D("1800.00"), D("12.00"), D("101.00"), D("0.01"))


def test_gstin(spark):
    numbers = ["27AAPFS4321L1ZS", "27AAFP54321L1ZK", "27AAPFS4321L1ZT", "short", None]
    df = spark.createDataFrame([(n,) for n in numbers], "g string")
    assert [r[0] for r in df.select(gstin.gstin_reason(F.col("g"))).collect()] == [None, "layout", "check_digit", "length", "empty"]


def test_withheld_rate(spark):
    w = tax.withheld_rate(F.lit("59000").cast("decimal(18,2)"), F.lit("50000").cast("decimal(18,2)"), F.lit("54000").cast("decimal(18,2)"))
    r = one(spark, w.alias("w"))["w"]
    assert (r["shortfall"], r["rate"]) == (D("5000.00"), D("10.000"))


def test_dates(spark):
    rows = [("01/02/2026", "dd/MM/yyyy", "2026-02-01"), ("31/02/2026", "dd/MM/yyyy", None), ("05-Sept-26", "dd-MMM-yyyy", "2026-09-05"),
            ("2026-03-04", "yyyy-MM-dd", "2026-03-04"), ("03/04/2026", "MM/dd/yyyy", "2026-03-04"), ("1/2/75", "dd/MM/yy", "1975-02-01"),
            ("01/02/2026 10:30", "dd/MM/yyyy", "2026-02-01"), ("-", "dd/MM/yyyy", None), ("total", "dd/MM/yyyy", None)]
    df = spark.createDataFrame(rows, "raw string, fmt string, want string")
    for r in df.select("raw", "want", dates.parse_date(F.col("raw"), F.col("fmt")).cast("string").alias("got")).collect():
        assert r["got"] == r["want"], r


def test_amounts(spark):
    rows = [("1,23,456.78", "123456.78", False, None), ("(500.00)", "500.00", True, None), ("2,41,933.51CR", "241933.51", False, "cr"),
            ("500 Dr", "500.00", True, "dr"), ("-12.345", "12.35", True, None), ("₹ 10", "10.00", False, None)]
    df = spark.createDataFrame(rows, "raw string, value string, neg boolean, suffix string")
    for r in df.withColumn("a", text.parse_amount(F.col("raw"))).collect():
        assert (str(r["a"]["value"]), r["a"]["negative"], r["a"]["suffix"]) == (r["value"], r["neg"], r["suffix"]), r
    b = spark.createDataFrame([("-",), ("nil",), ("",), ("abc",)], "raw string").withColumn("a", text.parse_amount(F.col("raw"))).collect()
    assert [x["a"]["blank"] for x in b] == [True, True, True, False] and b[3]["a"]["valid"] is False


def test_narrations(spark):
    rows = [("UPI/123456789012/Payment from/ramesh@okhdfcbank/UPI", "upi", "123456789012"),
            ("UPI-XXXXXXX7140-SBIN0000641-624861888406", "upi", "624861888406"),
            ("NEFT-CITIN52024061012345-ACME TRADING PVT LTD-UTR123456789", "neft", "CITIN52024061012345"),
            ("IMPS/P2A/412345678901/RAMESH KUMAR/HDFC", "imps", "412345678901"), ("BY CASH DEPOSIT", "cash", None),
            ("ACH C- EXAMPLE COMPANY-32256648", "nach", "32256648"), ("INT.PD:01-04-2026 TO 30-06-2026", "interest", None),
            ("SMS CHARGES QTR", "charge", None), ("SOMETHING ELSE", None, None)]
    df = spark.createDataFrame(rows, "narration string, mode string, ref string").withColumn("rule", text.narration_rule(F.col("narration")))
    p = text.parse_narration(F.col("narration"), F.col("rule"))
    for r in df.select("narration", "mode", "ref", p["payment_mode"].alias("m"), p["reference"].alias("r")).collect():
        assert (r["m"], r["r"]) == (r["mode"], r["ref"]), r


def test_repair(spark):
    rows = [("22.196.90cz", "22,196.90cr"), ("01.06.2022", "01.06.2022"), ("31.12.22", "31.12.22"), ("SBINO000641 x", "SBIN0000641 x"), ("1.14.197.81", "1,14,197.81")]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert all(r[0] == r[1] for r in df.select("want", text.repair_text(F.col("raw"))).collect())
