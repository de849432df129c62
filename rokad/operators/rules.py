"""Learned rules on bank lines: the first rule of the client that fits a line, found by what its text must contain.

A rule is compiled to a literal that every fitting narration has: its prefix, what it must contain, or the longest text that its pattern
cannot match without. The last characters of that literal are its key, and lines meet rules by (client, characters) instead of
by client, so a client with very many lines and rules never pairs them all; only then are all conditions of the pair checked. Rules without any literal
are looked up by payment mode, or, if they have none, by client, as they may fit every line.
"""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: Characters of a literal that make its key; shorter literals are keys as they are.
GRAM = 4


def required_literal(pattern: str | None) -> str:
    """The longest upper-case text that every match of the pattern contains; empty where none is sure."""
    if not pattern:
        return ""
    parser = re._parser
    best, run = "", ""

    def end() -> None:
        nonlocal best, run
        best, run = max(best, run, key=len), ""

    def walk(items) -> None:
        nonlocal run
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(value).upper()
            elif name == "SUBPATTERN":
                walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                # its content occurs, but what stands before and after need not be next to it
                end()
                walk(value[2])
                end()
            elif name != "AT":
                end()

    try:
        walk(parser.parse(pattern))
    except re.error:
        return ""
    end()
    return best


def _required(patterns: pd.Series) -> pd.Series:
    return patterns.map(required_literal)


def compiled(rules: DataFrame) -> DataFrame:
    """Rules with their key."""
    literal = F.coalesce(F.upper("contains"), F.upper("starts_with"), F.pandas_udf(_required, "string")("regex"))
    key = F.when(F.length("literal") > 0, F.right(F.col("literal"), F.lit(GRAM))).otherwise(F.concat(F.lit("\x01"), F.coalesce("payment_mode", F.lit(""))))
    return rules.withColumn("literal", literal).withColumn("key", key).drop("literal")


def _keys(narration: Column, mode: Column, sizes: list[int]) -> Column:
    """All keys that a line can meet, for the key lengths that there are."""
    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(narration) - (n - 1))
        return F.when(F.length(narration) >= n, F.transform(starts, lambda i: F.substring(narration, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[pieces(n) for n in sizes], F.array(F.lit("\x01"), F.concat(F.lit("\x01"), F.coalesce(mode, F.lit(""))))))


def apply_rules(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """client_id, line_id, rule_id, action, target_account of the first fitting rule by priority, then id.

    rules: client_id, rule_id, priority, starts_with, contains, regex, payment_mode, direction, amount_min, amount_max, action, target_account; a
    missing condition fits. Text is compared in upper case; a pattern may match anywhere.
    """
    rules = stage(compiled(rules))
    # lengths of keys, at most GRAM of them; keys without a literal begin with a mark
    sizes = sorted(r[0] for r in rules.filter("key NOT LIKE '\x01%'").select(F.length("key")).distinct().collect())
    own = rules.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    amount, direction = F.col("debit") + F.col("credit"), F.when(F.col("debit") > 0, "debit").otherwise("credit")
    text = lines.select("client_id", "line_id", F.upper("narration").alias("n"), "payment_mode", direction.alias("direction"), amount.alias("amount"))
    met = text.withColumn("key", F.explode(_keys(F.col("n"), F.col("payment_mode"), sizes)))
    c = F.col
    missing_or = lambda name, fits: c(f"r_{name}").isNull() | fits
    fit = (
        missing_or("starts_with", c("n").startswith(F.upper("r_starts_with"))) & missing_or("contains", c("n").contains(F.upper("r_contains")))
        & missing_or("regex", F.regexp_like("n", "r_regex")) & missing_or("payment_mode", c("r_payment_mode") == c("payment_mode"))
        & missing_or("direction", c("r_direction") == c("direction")) & missing_or("amount_min", c("amount") >= c("r_amount_min"))
        & missing_or("amount_max", c("amount") <= c("r_amount_max")))
    hits = met.join(own, (c("client_id") == c("r_client_id")) & (c("key") == c("r_key"))).filter(F.coalesce(fit, F.lit(False)))
    first = F.min(F.struct("r_priority", "r_rule_id", "r_action", "r_target_account")).alias("h")
    return hits.groupBy("client_id", "line_id").agg(first).select(
        "client_id", "line_id", c("h.r_rule_id").alias("rule_id"), c("h.r_action").alias("action"), c("h.r_target_account").alias("target_account"))
