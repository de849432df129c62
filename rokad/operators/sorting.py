"""Rows in a global order: several keys, nulls last, over all partitions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .staging import stage


def by(*names: str) -> list[Column]:
    """Sort columns from names; a leading minus sorts down. Nulls are last either way."""
    return [F.col(n[1:]).desc_nulls_last() if n.startswith("-") else F.col(n).asc_nulls_last() for n in names]


def write_sorted(df: DataFrame, path: str, *names: str, fmt: str = "parquet") -> None:
    """Write df so that the files, in the order of their names, and the rows in each are in the order asked for.

    Rows are dealt by ranges of the keys, so no task sorts more than its range. Ranges of equal keys stay together; end the names with a unique
    column where a key is shared by very many rows.
    """
    df.orderBy(*by(*names)).write.format(fmt).save(path)


def with_position(df: DataFrame, *names: str, out: str = "position") -> DataFrame:
    """Add each row's 1-based place in the order: its place in its range plus the rows of the ranges before, one number per range."""
    placed = stage(df.orderBy(*by(*names)).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_part", "_first", before.alias("_before"))
    return placed.join(starts, "_part").withColumn(out, F.col("_before") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_first", "_before")
