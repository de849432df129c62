"""Date-effective lookups: longest-prefix tax rate, withholding section, threshold, fiscal period."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import dates
from .staging import stage


#: Distinct codes, of under a hundred bytes a rate row, up to which their rates are sent to every task.
SENT_CODES = 20_000


def _in_force(rows: Column, on: Column) -> Column:
    """First struct of an already ranked array that covers the date."""
    return F.get(F.filter(rows, lambda r: (on >= r["effective_from"]) & (
        r["effective_to"].isNull() | (on <= r["effective_to"]))), F.lit(0))


def resolve_gst_rate(items: DataFrame, rates: DataFrame, hsn: str, on: str) -> DataFrame:
    """Add the rate row in force for each code: longest prefix first, then latest start.

    Distinct codes (a column-pruned scan, deduplicated map-side) are expanded to their prefixes, so
    the prefix match is an equi join with the master; each code then carries its ranked rate rows.
    """
    cols = ["rate_id", "hsn_prefix", "gst_rate", "cess_rate", "citation", "effective_from", "effective_to"]
    probes = items.select(hsn).distinct().select(
        hsn, F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(hsn), F.lit(1))),
            lambda n: F.substring(F.col(hsn), F.lit(1), n))).alias("hsn_prefix"))
    ranked = probes.join(F.broadcast(rates), "hsn_prefix").groupBy(hsn).agg(
        F.sort_array(F.collect_list(F.struct(
            F.length("hsn_prefix").alias("_len"), F.col("effective_from").alias("_from"), F.struct(*cols).alias("r"))),
            asc=False).alias("_ranked"))
    hit = _in_force(F.transform("_ranked", lambda x: x["r"]), F.col(on))
    ranked = stage(ranked)
    if ranked.count() <= SENT_CODES:  # so few rows go to every task, and the items stay where they are
        ranked = F.broadcast(ranked)
    return items.join(ranked, hsn, "left").withColumn("_r", hit).select(
        *items.columns, *[F.col(f"_r.{c}").alias(f"master_{c}") for c in cols])


def resolve_tds_section(payments: DataFrame, sections: DataFrame, on: str) -> DataFrame:
    """Add the withholding section in force for (tds_category, entity_type) on the date.

    The literal master is folded to one row per key holding its ranked sections and broadcast, so
    the payments are read once and not shuffled.
    """
    cols = ["section_id", "tds_rate", "single_threshold", "cumulative_threshold", "full_on_crossing",
            "effective_from", "effective_to"]
    ranked = sections.groupBy("tds_category", "entity_type").agg(F.sort_array(F.collect_list(F.struct(
        F.col("effective_from").alias("_from"), F.struct(*cols).alias("r"))), asc=False).alias("_ranked"))
    hit = _in_force(F.transform("_ranked", lambda x: x["r"]), F.col(on))
    return payments.join(F.broadcast(ranked), ["tds_category", "entity_type"], "left").withColumn(
        "_s", hit).select(*payments.columns, *[F.col(f"_s.{c}").alias(c) for c in cols[:5]])


def threshold_on(rows: list[tuple], key: str, on: Column) -> Column:
    """Threshold value in force for one key; `rows` is the literal master, latest start wins."""
    value = F.lit(None).cast("decimal(18,2)")
    for k, start, end, amount in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
        inside = on >= F.lit(start).cast("date")
        if end:
            inside = inside & (on <= F.lit(end).cast("date"))
        value = F.when(inside, F.lit(amount).cast("decimal(18,2)")).otherwise(value)
    return value


def resolve_period(facts: DataFrame, closed: DataFrame, on: str) -> DataFrame:
    """Add fiscal year and month period with the open/closed state of the posting date.

    `closed` holds one row per (client_id, period_start) that is closed; periods are calendar
    months, so the point-in-range lookup is an equi join on the month.
    """
    df = facts.withColumn("fy", dates.fy_start(F.col(on))).withColumn(
        "period_start", dates.month_start(F.col(on)))
    marks = closed.select("client_id", "period_start", F.lit(True).alias("_closed"))
    return (
        df.join(marks, ["client_id", "period_start"], "left")
        .withColumn("period_closed", F.coalesce("_closed", F.lit(False)))
        .drop("_closed")
    )


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key under the order; the per-task limit is applied before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
