"""Bank reports: line status, statement checks, reconciliation statement, cash episodes, cheques."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.money import MONEY, nonnull, rupees, zero
from ..operators.prefix import carry_forward, running_sum
from .reports import net_by


def _d(text: str) -> Column:
    return F.lit(text).cast("date")


def line_status(lines: DataFrame, matches: DataFrame, as_of: str | None = None) -> DataFrame:
    """Allocated and open part of every line. With a date, matches made later or undone earlier do not count."""
    live = matches.filter(F.col("unmatched_on").isNull()) if as_of is None else matches.filter(
        (F.col("created_on") <= _d(as_of)) & (F.col("unmatched_on").isNull() | (F.col("unmatched_on") > _d(as_of))))
    sums = live.groupBy("line_id").agg(F.sum("amount").cast(MONEY).alias("_m"))
    amount = (F.col("debit") + F.col("credit")).cast(MONEY)
    df = lines.join(sums, "line_id", "left").withColumn("matched_amount", nonnull(F.col("_m"))).withColumn(
        "amount", amount)
    status = (
        F.when(F.col("is_ignored"), "ignored").when(F.col("matched_amount") == 0, "unmatched")
        .when(F.col("matched_amount") >= F.col("amount"), "matched").otherwise("partially_matched"))
    return df.withColumn("unmatched_amount", (F.col("amount") - F.col("matched_amount")).cast(MONEY)).withColumn(
        "status", status).drop("_m")


def statement_rows(lines: DataFrame, statements: DataFrame) -> DataFrame:
    """Every statement line with the balance expected from the previous stated balance.

    The expected value restarts from what the statement itself says, so one misprint is one bad row.
    """
    keys = ["account_id", "week"]
    levels, order = ["txn_date", "_chunk"], ["txn_date", "line_key"]
    run = running_sum(lines, keys, levels, order, {"_net": F.col("credit") - F.col("debit")})
    gap = F.col("running_balance") - F.col("_net")
    run = carry_forward(run, keys, levels, order, {"_anchor": gap.cast(MONEY)})
    opened = run.join(statements.select(*keys, "opening_balance"), keys)
    expected = F.coalesce(F.col("_anchor"), F.col("opening_balance")) + F.col("_net")
    return opened.select(
        "client_id", *keys, "line_id", "line_key", "txn_date", "debit", "credit", "running_balance",
        expected.cast(MONEY).alias("expected_balance"))


def statement_bad_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("running_balance").isNotNull() & (F.col("running_balance") != F.col("expected_balance")))


def statement_arithmetic(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Opening plus credits less debits against the declared closing, and the count of bad rows."""
    bad = F.col("running_balance").isNotNull() & (F.col("running_balance") != F.col("expected_balance"))
    g = rows.groupBy("account_id", "week").agg(
        F.sum("debit").cast(MONEY).alias("total_debits"), F.sum("credit").cast(MONEY).alias("total_credits"),
        F.count_if(bad).alias("bad_rows"),
        F.min_by("line_id", F.when(bad, F.struct("txn_date", "line_key"))).alias("first_bad_line"))
    j = statements.join(g, ["account_id", "week"])
    computed = (F.col("opening_balance") + F.col("total_credits") - F.col("total_debits")).cast(MONEY)
    diff = (F.col("closing_balance") - computed).cast(MONEY)
    return j.select(
        "account_id", "week", "opening_balance", "total_debits", "total_credits", computed.alias("computed_closing"),
        F.col("closing_balance").alias("declared_closing"), diff.alias("difference"), "bad_rows", "first_bad_line",
        ((diff == 0) & (F.col("bad_rows") == 0)).alias("ok"))


def statement_gaps(statements: DataFrame) -> DataFrame:
    """Days missing before a statement, or an opening that does not continue the previous closing."""
    w = W.partitionBy("account_id").orderBy("period_from", "week")
    df = statements.select(
        "account_id", "week", "period_from", "opening_balance",
        F.lag("period_to").over(w).alias("previous_to"), F.lag("closing_balance").over(w).alias("previous_closing"))
    days = F.datediff("period_from", "previous_to") - 1
    df = df.filter(F.col("previous_to") < F.col("period_from")).withColumn("gap_days", days).withColumn(
        "discontinuous", (days == 0) & (F.col("previous_closing") != F.col("opening_balance")))
    return df.filter((F.col("gap_days") > 0) | F.col("discontinuous"))


def pending_on(cheques: DataFrame, on: Column) -> DataFrame:
    """Cheques written by a date and neither cleared nor bounced by then."""
    return cheques.filter((F.col("cheque_date") <= on)
                          & (F.col("cleared_date").isNull() | (F.col("cleared_date") > on))
                          & (F.col("bounced_date").isNull() | (F.col("bounced_date") > on)))


def bank_reconciliation(net: DataFrame, lines: DataFrame, matches: DataFrame, cheques: DataFrame,
                        statements: DataFrame, stated: DataFrame, bank_account: int, as_of: str,
                        opening: str = "1000.00") -> DataFrame:
    """Books to bank for every account: five aggregates joined on the account.

    As of a past date, cheques cleared or bounced later still count as pending and matches are
    taken as they stood then. `net` holds the books by client and account as of the date (client_id, account_code, signed_paise).
    """
    on = _d(as_of)
    book = net.filter(F.col("account_code") == bank_account).groupBy("client_id").agg(F.sum("signed_paise").alias("_p")).select(
        F.col("client_id").cast("long").alias("account_id"), rupees(F.col("_p")).alias("book_balance"))
    pending = pending_on(cheques, on)
    issued = F.col("direction") == "issued"
    chq = pending.groupBy("account_id").agg(
        nonnull(F.sum(F.when(issued, F.col("amount")))).alias("unpresented"),
        nonnull(F.sum(F.when(~issued, F.col("amount")))).alias("uncredited"),
        F.count_if(issued).alias("unpresented_count"), F.count_if(~issued).alias("uncredited_count"))
    open_ = line_status(lines.filter(F.col("txn_date") <= on), matches, as_of).filter(
        (F.col("status") != "matched") & ~F.col("is_ignored"))
    bank = open_.groupBy("account_id").agg(
        nonnull(F.sum(F.when(F.col("debit") > 0, F.col("unmatched_amount")))).alias("bank_debits"),
        nonnull(F.sum(F.when(F.col("credit") > 0, F.col("unmatched_amount")))).alias("bank_credits"),
        F.count_if(F.col("debit") > 0).alias("bank_debit_count"),
        F.count_if(F.col("credit") > 0).alias("bank_credit_count"))
    closing = statements.filter(F.col("period_to") <= on).groupBy("account_id").agg(
        F.max_by("closing_balance", F.struct("period_to", "week")).alias("_closing"))
    last = stated.filter((F.col("txn_date") <= on) & F.col("running_balance").isNotNull()).groupBy("account_id").agg(
        F.max_by("running_balance", F.struct("txn_date", "line_key")).alias("_running"))
    accounts = lines.select("account_id").distinct()
    j = accounts
    for part in (book, chq, bank, closing, last):
        j = j.join(part, "account_id", "left")
    money_cols = ["book_balance", "unpresented", "uncredited", "bank_debits", "bank_credits"]
    counts = ["unpresented_count", "uncredited_count", "bank_debit_count", "bank_credit_count"]
    j = j.select("account_id", *[nonnull(F.col(c)).alias(c) for c in money_cols],
                 *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
                 F.coalesce("_closing", "_running", F.lit(opening).cast(MONEY)).alias("actual_balance"))
    c = F.col
    computed = (c("book_balance") + c("unpresented") - c("uncredited") - c("bank_debits") + c("bank_credits")).cast(MONEY)
    return j.select("*", computed.alias("computed_balance"),
                    (c("actual_balance") - computed).cast(MONEY).alias("difference"),
                    (c("actual_balance") == computed).alias("ties"))


def close_readiness(clients: DataFrame, accounts: DataFrame, reconciled: DataFrame, net: DataFrame, closed: DataFrame, label: str) -> DataFrame:
    """client_id, period, ready, n_blockers, blockers: what would stop a period of each client from closing.

    A period that is closed already, a bank account (client_id, account_id) whose reconciliation as of its end does not tie, or books (net by account) that do not
    balance. Blockers are codes, in order, joined by a comma; a client has a few accounts, so the list is short. No blocker: ready.
    """
    shut = closed.select("client_id", F.lit("closed").alias("blocker"))
    open_ = accounts.join(reconciled.filter("NOT ties").select("account_id"), "account_id", "left_semi").select(
        "client_id", F.concat(F.lit("bank:"), F.lpad(F.col("account_id").cast("string"), 12, "0")).alias("blocker"))
    broken = net.groupBy("client_id").agg(F.sum("signed_paise").alias("p")).filter("p <> 0").select("client_id", F.lit("unbalanced").alias("blocker"))
    found = shut.unionByName(open_).unionByName(broken).groupBy("client_id").agg(F.sort_array(F.collect_set("blocker")).alias("b"))
    own = F.coalesce("b", F.array().cast("array<string>"))
    return clients.select("client_id").join(found, "client_id", "left").select(
        "client_id", F.lit(label).alias("period"), (F.size(own) == 0).alias("ready"), F.size(own).alias("n_blockers"), F.array_join(own, ",").alias("blockers"))


def unpresented_numbers(cheques: DataFrame, as_of: str) -> DataFrame:
    """Pending issued cheques with their position by date per account, for the detail line of the statement."""
    return pending_on(cheques, _d(as_of)).filter(F.col("direction") == "issued").select(
        "account_id", "cheque_number", "cheque_date", "amount", "voucher_id")


def cash_register(ledger: DataFrame, cash_accounts: list[int], start: str, end: str) -> DataFrame:
    """First day of every stretch of days on which a cash account closed below zero.

    Days are summed first, so the window runs over at most one row per account and day.
    """
    keys = ["client_id", "account_code"]
    legs = ledger.filter(F.col("account_code").isin(cash_accounts) & (F.col("posting_date") <= _d(end)))
    day = net_by(legs, *keys, "posting_date")
    w = W.partitionBy(*keys).orderBy("posting_date")
    run = day.withColumn("balance", F.sum("net").over(w.rowsBetween(W.unboundedPreceding, 0)).cast(MONEY))
    run = run.filter(F.col("posting_date") >= _d(start)).withColumn("_below", F.col("balance") < 0)
    first = run.withColumn(
        "_before", F.lag("_below", 1, False).over(w)).filter(F.col("_below") & ~F.col("_before"))
    return first.select(*keys, F.col("posting_date").alias("date"), "balance", (-F.col("balance")).cast(MONEY).alias(
        "shortfall"))


def cash_episode_vouchers(episodes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Vouchers posted on the first day of each episode."""
    e = episodes.select("client_id", "account_code", F.col("date").alias("posting_date"))
    return ledger.join(e, ["client_id", "account_code", "posting_date"], "left_semi").select(
        "client_id", "account_code", "posting_date", "voucher_id", "voucher_type",
        (F.col("debit") - F.col("credit")).cast(MONEY).alias("amount"))


def stale_cheques(cheques: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    age = F.datediff(_d(as_of), F.col("cheque_date"))
    return cheques.filter((F.col("status") == "pending") & (age > days)).select(
        "client_id", "cheque_number", "voucher_id", "cheque_date", "direction", "amount", age.alias("age_days"))


def cheque_events(cheques: DataFrame) -> DataFrame:
    """Cleared cheques with float days; bounced ones with the reversal to post and the legal flag."""
    return cheques.filter(F.col("status") != "pending").select(
        "client_id", "voucher_id", "cheque_number", "direction", "amount", "status",
        F.datediff("cleared_date", "cheque_date").alias("float_days"),
        F.when(F.col("status") == "bounced", F.concat(F.lit("RV-"), "voucher_id")).alias("reversal_id"),
        F.coalesce("cleared_date", "bounced_date").alias("event_date"),
        ((F.col("status") == "bounced") & (F.col("direction") == "received")).alias("section_138"))


def new_lines(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Lines whose content hash is new for the account, one per hash, ready to append."""
    first = lines.groupBy("account_id", "content_hash").agg(
        F.min(F.struct("txn_date", "line_key", "line_id")).alias("_f"), F.count(F.lit(1)).alias("copies"))
    return first.join(known.select("account_id", "content_hash"), ["account_id", "content_hash"], "left_anti").select(
        "account_id", "content_hash", "_f.line_id", "copies")
