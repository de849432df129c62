"""Books reports. Every report is a query over ledger legs; no balance is stored."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.money import MONEY, nonnull, rupees, zero
from ..operators.prefix import running_sum


def statutory(legs: DataFrame) -> DataFrame:
    return legs.filter(F.col("finance_book_id").isNull())


def as_of(legs: DataFrame, date: str) -> DataFrame:
    return legs.filter(F.col("posting_date") <= F.lit(date).cast("date"))


def between(legs: DataFrame, start: str, end: str) -> DataFrame:
    return legs.filter(F.col("posting_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def net_by(legs: DataFrame, *keys: str) -> DataFrame:
    """Debit minus credit per key; summed as long paise when the legs carry them."""
    if "signed_paise" in legs.columns:
        return legs.groupBy(*keys).agg(F.sum("signed_paise").alias("_p")).select(
            *keys, rupees(F.col("_p")).alias("net"))
    return legs.groupBy(*keys).agg((F.sum("debit") - F.sum("credit")).cast(MONEY).alias("net"))


def trial_balance(legs: DataFrame, chart: DataFrame, date: str) -> DataFrame:
    """Net per client and account as of a date, split by side, zero rows dropped."""
    return trial_balance_of(net_by(as_of(statutory(legs), date), "client_id", "account_code"), chart)


def trial_balance_of(net: DataFrame, chart: DataFrame) -> DataFrame:
    """The same from the net (client_id, account_code, net)."""
    return net.filter("net <> 0").join(F.broadcast(chart), "account_code").select(
        "client_id", "account_code", "account_name", "root_type",
        F.greatest(F.col("net"), zero()).alias("debit"), F.greatest(-F.col("net"), zero()).cast(MONEY).alias("credit"))


def trial_balance_totals(tb: DataFrame) -> DataFrame:
    return tb.groupBy("client_id").agg(
        F.sum("debit").cast(MONEY).alias("total_debit"), F.sum("credit").cast(MONEY).alias("total_credit"),
        (F.sum("debit") == F.sum("credit")).alias("balanced"))


def _sum_when(cond: Column, name: str) -> Column:
    return nonnull(F.sum(F.when(cond, F.col("amount")))).alias(name)


def profit_and_loss(legs: DataFrame, chart: DataFrame, start: str, end: str) -> DataFrame:
    """Waterfall per client over a date range; opening legs are not this year's result."""
    net = net_by(between(statutory(legs), start, end).filter(~F.col("is_opening")), "client_id", "account_code")
    j = net.join(F.broadcast(chart.filter(F.col("root_type").isin("income", "expense"))), "account_code")
    income = F.col("root_type") == "income"
    j = j.withColumn("amount", F.when(income, -F.col("net")).otherwise(F.col("net")))
    cls = F.col("expense_class")
    s = j.groupBy("client_id").agg(
        _sum_when(income, "revenue"), _sum_when(~income & (cls == "cogs"), "cogs"),
        _sum_when(~income & (cls == "opex"), "operating_expenses"),
        _sum_when(~income & (cls == "non_operating"), "non_operating"))
    gross = F.col("revenue") - F.col("cogs")
    operating = gross - F.col("operating_expenses")
    return s.select(
        "client_id", "revenue", "cogs", gross.cast(MONEY).alias("gross_profit"), "operating_expenses",
        operating.cast(MONEY).alias("operating_profit"), "non_operating",
        (operating - F.col("non_operating")).cast(MONEY).alias("net_profit"))


def balance_sheet(legs: DataFrame, chart: DataFrame, date: str) -> DataFrame:
    """Position per client as of a date; the undistributed result is shown inside equity."""
    return balance_sheet_of(net_by(as_of(statutory(legs), date), "client_id", "account_code"), chart)


def balance_sheet_of(net: DataFrame, chart: DataFrame) -> DataFrame:
    """The same from the net (client_id, account_code, net)."""
    j = net.join(F.broadcast(chart), "account_code")
    root, liq = F.col("root_type"), F.coalesce(F.col("liquidity_class"), F.lit(""))
    j = j.withColumn("amount", F.when(root == "asset", F.col("net")).otherwise(-F.col("net")))
    s = j.groupBy("client_id").agg(
        _sum_when((root == "asset") & (liq == "current"), "current_assets"),
        _sum_when((root == "asset") & (liq != "current"), "non_current_assets"),
        _sum_when((root == "liability") & (liq == "current"), "current_liabilities"),
        _sum_when((root == "liability") & (liq != "current"), "non_current_liabilities"),
        _sum_when(root == "equity", "equity"),
        _sum_when(root.isin("income", "expense"), "retained_profit"))
    c = F.col
    assets = (c("current_assets") + c("non_current_assets")).cast(MONEY)
    liabilities = (c("current_liabilities") + c("non_current_liabilities")).cast(MONEY)
    equity = (c("equity") + c("retained_profit")).cast(MONEY)
    return s.select(
        "*", assets.alias("total_assets"), liabilities.alias("total_liabilities"), equity.alias("total_equity"),
        (assets == liabilities + equity).alias("balanced"),
        (c("current_assets") - c("current_liabilities")).cast(MONEY).alias("working_capital"))


def account_ledger(legs: DataFrame, start: str, end: str, accounts: list[int] | None = None,
                   id_span: int = 1 << 20) -> DataFrame:
    """Running balance per client and account inside a date range, with the balance before the range."""
    keys = ["client_id", "account_code"]
    rows = legs if accounts is None else legs.filter(F.col("account_code").isin(accounts))
    opening = net_by(rows.filter(F.col("posting_date") < F.lit(start).cast("date")), *keys).withColumnRenamed(
        "net", "opening_balance")
    return account_ledger_of(between(rows, start, end), opening, id_span)


def account_ledger_of(rows: DataFrame, opening: DataFrame, id_span: int = 1 << 20) -> DataFrame:
    """The same from the legs of the range and the balance before it (client_id, account_code, opening_balance).

    An account's day is a chunk of its own, and only ids far apart divide it: chunks stay few beside their rows when there are more rows a day.
    """
    keys, p = ["client_id", "account_code"], F.col("signed_paise")
    rows = rows.withColumn("_chunk", F.floor(F.col("doc_key") / id_span)).withColumn("_party", F.coalesce("party_id", F.lit("")))
    run = running_sum(rows, keys, ["posting_date", "_chunk"], ["posting_date", "doc_key", "voucher_id", "_party"], {"_running": p}, "long")
    return run.join(F.broadcast(opening), keys, "left").select(
        *keys, "posting_date", "voucher_id", "voucher_type", "party_id", rupees(F.greatest(p, F.lit(0))).alias("debit"), rupees(F.greatest(-p, F.lit(0))).alias("credit"),
        rupees(F.col("_running")).alias("running_balance"), nonnull(F.col("opening_balance")).alias("opening_balance"))
