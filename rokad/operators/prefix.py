"""Running totals, running maxima and carried values that stay parallel when one key holds most of the rows.

A plain ordered window puts all rows of a key into one task. Here each key is cut into ordered
chunks by `levels`, columns that never decrease along the order (a date, then an id range): every value of
a call is folded per chunk in one map-side aggregation, a small window runs over chunks, and the row-level
window is partitioned by key and chunk. Any associative fold can be carried so; sums, maxima and last values are here.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W, WindowSpec

#: output -> (kind, value); kinds are sum, max and last (non-null)
Folds = dict[str, tuple[str, Column]]


def _fold(kind: str, value: Column, order: list[str]) -> Column:
    """Value of a group of rows."""
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return F.sum(value) if kind == "sum" else F.max(value)


def _over(kind: str, value: Column, w: WindowSpec) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(w)
    return (F.sum(value) if kind == "sum" else F.max(value)).over(w)


def _then(kind: str, before: Column, after: Column) -> Column:
    """Fold of two neighbouring stretches from their folds."""
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(after, F.lit(0))
    return F.greatest(before, after) if kind == "max" else F.coalesce(after, before)


def _offsets(parts: DataFrame, keys: list[str], levels: list[str], kinds: dict[str, str]) -> DataFrame:
    """_o_<output>: the fold of all chunks before each chunk, resolved one level at a time."""
    tables = [parts]
    for i in range(len(levels) - 1, 0, -1):
        tables.append(tables[-1].groupBy(*keys, *levels[:i]).agg(*[_fold(k, F.col(f"_v_{n}"), [levels[i]]).alias(f"_v_{n}") for n, k in kinds.items()]))
    out = None
    for i, table in enumerate(reversed(tables)):
        w = W.partitionBy(*keys, *levels[:i]).orderBy(levels[i]).rowsBetween(W.unboundedPreceding, -1)
        step = table.select(*keys, *levels[: i + 1], *[_over(k, F.col(f"_v_{n}"), w).alias(f"_c_{n}") for n, k in kinds.items()])
        if out is None:
            out = step.select(*keys, *levels[: i + 1], *[F.col(f"_c_{n}").alias(f"_o_{n}") for n in kinds])
        else:
            out = step.join(out, [*keys, *levels[:i]], "left").select(
                *keys, *levels[: i + 1], *[_then(k, F.col(f"_o_{n}"), F.col(f"_c_{n}")).alias(f"_o_{n}") for n, k in kinds.items()])
    return out


def scan(df: DataFrame, keys: list[str], levels: list[str], order: list[str], values: Folds, inclusive: bool = True) -> DataFrame:
    """Add the fold of each value over the rows up to (inclusive) or strictly before each row, per key along the order.

    Keys and levels must not be null. All values share one aggregation, one join and one window.
    """
    kinds = {n: k for n, (k, _) in values.items()}
    src = df.withColumns({f"_x_{n}": v for n, (_, v) in values.items()})
    parts = src.groupBy(*keys, *levels).agg(*[_fold(k, F.col(f"_x_{n}"), order).alias(f"_v_{n}") for n, k in kinds.items()])
    w = W.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    # the window first: its rows lie and are sorted as the join with the chunks needs them, so they are shuffled and sorted once
    own = src.withColumns({f"_w_{n}": _over(k, F.col(f"_x_{n}"), w) for n, k in kinds.items()}).drop(*[f"_x_{n}" for n in kinds])
    joined = own.join(_offsets(parts, keys, levels, kinds), [*keys, *levels])
    joined = joined.withColumns({n: _then(k, F.col(f"_o_{n}"), F.col(f"_w_{n}")) for n, k in kinds.items()})
    return joined.drop(*[f"_w_{n}" for n in kinds], *[f"_o_{n}" for n in kinds])


#: Keys are dealt into this many buckets by hash to find those with very many rows, and the rows of a bucket from which its keys are cut into chunks.
BUCKETS, HOT_ROWS = 1 << 20, 1 << 20


def split_hot(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key is small enough for a plain window, and the others, if there are any; df is read twice and should be staged.

    A bucket's rows are counted map-side. A bucket holds all rows of its keys, and so few are hot (one in hot_rows of the rows) that they are sent to every task.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    hot = [r[0] for r in df.groupBy(bucket.alias("b")).count().filter(F.col("count") > hot_rows).select("b").collect()]
    if not hot:
        return df, None
    few = F.broadcast(df.sparkSession.createDataFrame([(b,) for b in hot], "_b long"))
    marked = df.withColumn("_b", bucket)
    return marked.join(few, "_b", "left_anti").drop("_b"), marked.join(few, "_b", "left_semi").drop("_b")


def running_sum(df: DataFrame, keys: list[str], levels: list[str], order: list[str],
                values: dict[str, Column], type_: str = "decimal(18,2)") -> DataFrame:
    """Add inclusive running sums `{output: value}` per key along the order. Keys and levels must not be null."""
    out = scan(df, keys, levels, order, {n: ("sum", v) for n, v in values.items()})
    return out.withColumns({n: F.col(n).cast(type_) for n in values})


def running_sum_by_size(df: DataFrame, keys: list[str], levels: list[str], order: list[str], values: dict[str, Column],
                        type_: str = "decimal(18,2)", hot_rows: int = HOT_ROWS) -> DataFrame:
    """running_sum for keys that are mostly small: those run in a plain window over one shuffle, the others in chunks.

    df is read twice, once for its keys alone. Levels must not be null for the keys cut into chunks.
    """
    small, hot = split_hot(df, keys, hot_rows)
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = small.withColumns({n: F.coalesce(F.sum(v).over(w), F.lit(0)).cast(type_) for n, v in values.items()})
    return out if hot is None else out.unionByName(running_sum(hot, keys, levels, order, values, type_))


def carry_forward(df: DataFrame, keys: list[str], levels: list[str], order: list[str],
                  values: dict[str, Column]) -> DataFrame:
    """Add the last non-null value strictly before each row per key along the order."""
    return scan(df, keys, levels, order, {n: ("last", v) for n, v in values.items()}, inclusive=False)


def ordinal(df: DataFrame, keys: list[str], levels: list[str], order: list[str], out: str) -> DataFrame:
    """Add the gapless 1-based position of each row within its key along the order."""
    return running_sum(df, keys, levels, order, {out: F.lit(1).cast("long")}, "long")
