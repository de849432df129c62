"""Fixed reference tables: chart of accounts, tax rates, thresholds, withholding sections, credit rules.

All are literal and a few dozen rows long, so broadcasting them is bounded by this file.
"""
from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Chart leaves — code, name, root, account type, expense class, liquidity class, parent.
CHART = [
    (1010, "Cash", "asset", "cash", None, "current", 1001),
    (1020, "Bank Accounts", "asset", "bank", None, "current", 1001),
    (1030, "Debtors", "asset", "receivable", None, "current", 1001),
    (1041, "Input CGST Credit", "asset", "tax_input", None, "current", 1001),
    (1042, "Input SGST Credit", "asset", "tax_input", None, "current", 1001),
    (1043, "Input IGST Credit", "asset", "tax_input", None, "current", 1001),
    (1050, "TDS Receivable", "asset", "tds_receivable", None, "current", 1001),
    (1060, "Stock in Hand", "asset", "stock", None, "current", 1001),
    (1070, "Loans and Advances (Assets)", "asset", "general", None, "current", 1001),
    (1110, "Furniture and Fixtures", "asset", "fixed_asset", None, "non_current", 1100),
    (1120, "Office Equipment", "asset", "fixed_asset", None, "non_current", 1100),
    (1130, "Plant and Machinery", "asset", "fixed_asset", None, "non_current", 1100),
    (1190, "Accumulated Depreciation", "asset", "accumulated_depreciation", None, "non_current", 1100),
    (1900, "Temporary Opening", "asset", "temporary", None, "current", 1899),
    (2010, "Creditors", "liability", "payable", None, "current", 2001),
    (2021, "Output CGST Payable", "liability", "tax_output", None, "current", 2001),
    (2022, "Output SGST Payable", "liability", "tax_output", None, "current", 2001),
    (2023, "Output IGST Payable", "liability", "tax_output", None, "current", 2001),
    (2024, "Output Cess Payable", "liability", "tax_output", None, "current", 2001),
    (2030, "TDS Payable", "liability", "tds_payable", None, "current", 2001),
    (2110, "Bank Loan", "liability", "general", None, "non_current", 2100),
    (3010, "Owner's Capital", "equity", "capital", None, None, 3000),
    (3020, "Drawings", "equity", "drawings", None, None, 3000),
    (3030, "Reserves and Surplus", "equity", "equity", None, None, 3000),
    (4010, "Sales", "income", "general", None, None, 4001),
    (4020, "Service Income", "income", "general", None, None, 4001),
    (4110, "Interest Income", "income", "general", None, None, 4100),
    (4120, "Other Income", "income", "general", None, None, 4100),
    (5010, "Purchases", "expense", "cogs", "cogs", None, 5001),
    (5020, "Raw Materials", "expense", "cogs", "cogs", None, 5001),
    (5030, "Factory Wages", "expense", "cogs", "cogs", None, 5001),
    (5040, "Freight Inward", "expense", "cogs", "cogs", None, 5001),
    (5110, "Salary", "expense", "general", "opex", None, 5100),
    (5120, "Office Rent", "expense", "general", "opex", None, 5100),
    (5130, "Marketing", "expense", "general", "opex", None, 5100),
    (5140, "Travel Expenses", "expense", "general", "opex", None, 5100),
    (5150, "Utility Expenses", "expense", "general", "opex", None, 5100),
    (5160, "Professional Fees", "expense", "general", "opex", None, 5100),
    (5170, "Print and Stationery", "expense", "general", "opex", None, 5100),
    (5180, "Bank Charges", "expense", "general", "opex", None, 5100),
    (5190, "Depreciation", "expense", "general", "opex", None, 5100),
    (5191, "Motor Vehicle Expenses", "expense", "general", "opex", None, 5100),
    (5192, "Staff Welfare", "expense", "general", "opex", None, 5100),
    (5193, "Insurance", "expense", "general", "opex", None, 5100),
    (5195, "Bad Debts", "expense", "general", "opex", None, 5100),
    (5196, "CSR Expenses", "expense", "general", "opex", None, 5100),
    (5199, "Round Off", "expense", "round_off", "opex", None, 5100),
    (5210, "Interest on Loan", "expense", "general", "non_operating", None, 5200),
    (5220, "Income Tax", "expense", "general", "non_operating", None, 5200),
]
# Chart groups — code, name, root, parent.
CHART_GROUPS = [
    (1000, "Application of Funds (Assets)", "asset", None),
    (1001, "Current Assets", "asset", 1000),
    (1100, "Fixed Assets", "asset", 1000),
    (1899, "Temporary Accounts", "asset", 1000),
    (2000, "Source of Funds (Liabilities)", "liability", None),
    (2001, "Current Liabilities", "liability", 2000),
    (2100, "Loans (Liabilities)", "liability", 2000),
    (3000, "Capital Account", "equity", None),
    (4000, "Income", "income", None),
    (4001, "Direct Income", "income", 4000),
    (4100, "Indirect Income", "income", 4000),
    (5000, "Expenses", "expense", None),
    (5001, "Direct Expenses", "expense", 5000),
    (5100, "Indirect Expenses", "expense", 5000),
    (5200, "Non-Operating", "expense", 5000),
]
CASH, BANK, DEBTORS, TDS_RECEIVABLE, SUSPENSE = 1010, 1020, 1030, 1050, 1900
IN_CGST, IN_SGST, IN_IGST = 1041, 1042, 1043
CREDITORS, OUT_CGST, OUT_SGST, OUT_IGST, OUT_CESS, TDS_PAYABLE = 2010, 2021, 2022, 2023, 2024, 2030
RESERVES, SALES, SERVICE, INTEREST, BANK_CHARGES = 3030, 4010, 4020, 4110, 5180
DEPRECIATION, ACC_DEPRECIATION, ROUND_OFF = 5190, 1190, 5199

# Tax-rate master — id, prefix, from, to, rate, cess rate, citation.
_UNVERIFIED = "UNVERIFIED — predates the 2025-09-22 rate rationalisation"
GST_RATES = [
    (1, "99", "2017-07-01", None, "18", "0", _UNVERIFIED),
    (2, "7318", "2017-07-01", None, "18", "0", _UNVERIFIED),
    (3, "3506", "2017-07-01", None, "18", "0", _UNVERIFIED),
    (4, "4819", "2017-07-01", None, "18", "0", _UNVERIFIED),
    (5, "1006", "2017-07-01", None, "5", "0", _UNVERIFIED),
    (6, "3004", "2017-07-01", None, "5", "0", _UNVERIFIED),
    (7, "0401", "2017-07-01", None, "0", "0", _UNVERIFIED),
    (8, "2402", "2017-07-01", None, "28", "5", _UNVERIFIED),
]
# Compliance thresholds — key, from, to, value.
THRESHOLDS = [
    ("b2cl_value", "2017-07-01", None, 250000),
    ("b2cl_value", "2024-08-01", None, 100000),
    ("e_invoice_aato", "2023-08-01", None, 50000000),
]
# Withholding sections in force from 2026-04-01 —
# id, category, entity, rate, single threshold, cumulative threshold, full amount on crossing.
TDS_FROM = "2026-04-01"
TDS_SECTIONS = [
    (1, "Contractor Payments", "individual", "1", "30000", "100000", True),
    (2, "Contractor Payments", "company", "2", "30000", "100000", True),
    (3, "Contractor Payments", "no_pan", "20", "30000", "100000", True),
    (4, "Professional Fees", "individual", "10", "30000", "50000", True),
    (5, "Professional Fees", "company", "10", "30000", "50000", True),
    (6, "Professional Fees", "no_pan", "20", "30000", "50000", True),
    (7, "Rent on Plant / Machinery", "company", "2", "50000", "600000", True),
    (8, "Rent on Land / Building", "company", "10", "50000", "600000", True),
    (9, "Commission or Brokerage", "individual", "5", "0", "20000", True),
    (10, "Commission or Brokerage", "company", "5", "0", "20000", True),
    (11, "Commission or Brokerage", "no_pan", "20", "0", "20000", True),
    (12, "Interest other than on Securities", "individual", "10", "0", "10000", True),
    (13, "Interest other than on Securities", "no_pan", "20", "0", "10000", True),
    (14, "Purchase of Goods", "individual", "0.1", "0", "5000000", False),
    (15, "Purchase of Goods", "company", "0.1", "0", "5000000", False),
    (16, "Purchase of Goods", "no_pan", "5", "0", "5000000", False),
]
# Accounts whose input credit is not simply eligible, and blocked categories with
# the trades that unblock them.
ITC_RULES = [
    (5140, "blocked", "employee_travel"),
    (5196, "blocked", "csr"),
    (5191, "conditional", "motor_vehicles"),
    (5192, "conditional", "food_beverages"),
    (5193, "conditional", "rent_a_cab_insurance"),
]
BLOCKED_CATEGORIES = {
    "motor_vehicles": ["transport", "driving_school", "vehicle_dealer"],
    "food_beverages": ["catering", "restaurant"],
    "beauty_health": ["healthcare", "salon"],
    "club_membership": [],
    "rent_a_cab_insurance": ["insurance"],
    "employee_travel": [],
    "works_contract": ["construction", "works_contract"],
    "personal_consumption": [],
    "lost_or_gifted": [],
    "composition_supplier": [],
    "csr": [],
}


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of literal rows; its size is known to the planner."""
    fields = [f.strip().split(" ") for f in schema.split(", ")]

    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    casts = ", ".join(f"CAST(c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(fields))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def chart(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, CHART,
        "account_code int, account_name string, root_type string, account_type string, "
        "expense_class string, liquidity_class string, parent_code int")


def chart_groups(spark: SparkSession) -> DataFrame:
    return literal_table(spark, CHART_GROUPS, "code int, name string, root_type string, parent_code int")


def gst_rates(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, GST_RATES,
        "rate_id int, hsn_prefix string, effective_from date, effective_to date, "
        "gst_rate decimal(5,2), cess_rate decimal(5,2), citation string")


def thresholds(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, THRESHOLDS, "key string, effective_from date, effective_to date, value decimal(18,2)")


def tds_rows(revisions: list[tuple] = ()) -> list[tuple]:
    """Withholding rows with their first and last day; a revision has the row it replaces, its first day, then a row."""
    ends = {old: (date.fromisoformat(start) - timedelta(days=1)).isoformat() for old, start, *_ in revisions}
    return [(*r, TDS_FROM, ends.get(r[0])) for r in TDS_SECTIONS] + [(*r, start, None) for _, start, *r in revisions]


def tds_sections(spark: SparkSession, revisions: list[tuple] = ()) -> DataFrame:
    return literal_table(
        spark, tds_rows(revisions),
        "section_id int, tds_category string, entity_type string, tds_rate decimal(6,3), "
        "single_threshold decimal(18,2), cumulative_threshold decimal(18,2), full_on_crossing boolean, "
        "effective_from date, effective_to date")
