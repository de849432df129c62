"""Tax withheld at source with single and yearly thresholds, as a scan of composable functions.

What a payment does to the tax withheld so far, D, is a function of one form, D -> max(D + a, b): a payment that only meets the single
threshold adds its own tax (a); from the yearly threshold on, the total is at least rate x base (b, with a = 0). Two such functions one
after the other are again one of them, so the rule is an associative scan although rate, thresholds and kind may change
from one payment to the next. Written out, D after a payment is A + max(0, greatest (b - A) so far), with A the running sum of a: a sum and a
maximum that prefix.py carries from chunk to chunk.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.money import MONEY, pct, rupees, to_paise, zero
from .effective import resolve_tds_section
from .prefix import HOT_ROWS, running_sum, scan, split_hot
from .staging import stage

KEYS = ["client_id", "party_id", "_category", "fy"]
LEVELS = ["payment_date", "_chunk"]
ORDER = ["payment_date", "ok", "sk"]
ID_SPAN = 1 << 20


def _rules(run: DataFrame) -> DataFrame:
    """From the cumulative amount: whether thresholds are passed, the tax a payment adds by itself (_a) and what is due in total (_b)."""
    c = F.col
    after, thr, covered, full = c("cumulative_after"), c("cumulative_threshold"), c("section_id").isNotNull(), c("full_on_crossing")
    before = (after - c("amount")).cast(MONEY)
    run = run.select(
        "*", before.alias("cumulative_before"), F.coalesce((thr > 0) & (after >= thr), F.lit(False)).alias("_over"),
        F.coalesce((thr > 0) & (before >= thr), F.lit(False)).alias("_was"))
    single = covered & ~c("_over") & (c("single_threshold") > 0) & (c("amount") >= c("single_threshold"))
    total = F.when(full, after).otherwise(after - thr).cast(MONEY)
    return run.select("*", F.coalesce(F.when(single, to_paise(pct(c("amount"), c("tds_rate")))), F.lit(0)).cast("long").alias("_a"),
                      F.when(c("_over"), to_paise(pct(total, c("tds_rate")))).alias("_b"))


def _result(run: DataFrame, columns: list[str]) -> DataFrame:
    """Base and tax from the sum of _a up to a payment (_sum) and the greatest of _b less that sum before it (_m)."""
    c = F.col
    after, thr, full, charged = c("cumulative_after"), c("cumulative_threshold"), c("full_on_crossing"), (c("_a") > 0) | c("_b").isNotNull()
    held = c("_sum") - c("_a") + F.greatest(F.coalesce("_m", F.lit(0)), F.lit(0))
    base = (
        F.when(c("_over") & full, after)
        .when(c("_over") & c("_was"), c("amount"))
        .when(c("_over"), after - thr)
        .when(c("_a") > 0, c("amount")).cast(MONEY))
    tax = F.when(c("_over"), F.greatest(c("_b") - held, F.lit(0))).otherwise(c("_a"))
    return run.select(*columns, F.when(charged, base).otherwise(zero()).alias("taxable_base"), rupees(F.when(charged, tax).otherwise(0)).alias("tds"),
                      (c("_over") & ~c("_was")).alias("threshold_crossed"))


def _windows(df: DataFrame) -> DataFrame:
    """Keys of bounded size: all three scans over one shuffle and one sort."""
    w = W.partitionBy(*KEYS).orderBy(*ORDER)
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    run = _rules(df.withColumn("cumulative_after", rupees(F.sum(to_paise(F.col("amount"))).over(upto))))
    run = run.withColumn("_sum", F.sum("_a").over(upto))
    return run.withColumn("_m", F.max(F.col("_b") - F.col("_sum")).over(before))


def _chunks(df: DataFrame) -> DataFrame:
    """Keys of any size, cut into chunks by date and id range."""
    c = F.col
    df = df.withColumn("_chunk", F.floor(c("ok") / ID_SPAN))
    run = stage(_rules(running_sum(df, KEYS, LEVELS, ORDER, {"cumulative_after": c("amount")})))
    # only rows that charge something, or may, take part in the two scans that follow
    charged = running_sum(run.filter("_a > 0 OR _b IS NOT NULL"), KEYS, LEVELS, ORDER, {"_sum": c("_a")}, "long")
    charged = scan(charged, KEYS, LEVELS, ORDER, {"_m": ("max", c("_b") - c("_sum"))}, inclusive=False)
    none = F.lit(None).cast("long")
    return charged.unionByName(run.filter("_a = 0 AND _b IS NULL").select("*", none.alias("_sum"), none.alias("_m")))


def compute(payments: DataFrame, sections: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add section, cumulative, base, rate and tax to every payment; payments are read twice and should be staged.

    Cumulative counts every payment of the party in the category and fiscal year. Before the
    yearly threshold a payment is charged only when it meets the single threshold. From the
    crossing on, what has been withheld in total is rate x cumulative (or rate x excess, for
    sections charging only the excess) by the row in force on the payment's date, never less than what was withheld before it: a lower
    rate takes nothing back, and a higher one charges the whole base. A payment without a section in force is not charged.
    """
    small, hot = split_hot(payments.withColumn("_category", F.coalesce("tds_category", F.lit(""))), KEYS, hot_rows)
    columns = [*payments.columns, "section_id", "tds_rate", "cumulative_before", "cumulative_after"]
    out = _result(_windows(resolve_tds_section(small, sections, "payment_date")), columns)
    if hot is None:
        return out
    return out.unionByName(_result(_chunks(resolve_tds_section(hot, sections, "payment_date")), columns))
