"""One-to-one pairing: rank pairing of equal keys, and rounds of mutual best choice over scored candidates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .staging import stage

#: Rounds after which the mutual-best choice gives up with an error instead of running on.
MOST_ROUNDS = 1000


def rank_pairs(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """l, r: rows of both sides with equal keys, paired in order, so that each is used once. Null keys pair nothing.

    Both sides are shuffled once, together and by the keys alone: a key's left rows come first, so running counts number both sides, and
    the rows with one number meet where they are. A join on keys and number would shuffle both sides once more.
    """
    c = F.col

    def side(df: DataFrame, number: int) -> DataFrame:
        return df.select(*keys, *[x for x in order if x not in keys], "id", F.lit(number).alias("_side"))

    both = side(left, 0).unionByName(side(right, 1)).na.drop(subset=keys)
    w = W.partitionBy(*keys).orderBy("_side", *order, "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("_all", F.count(F.lit(1)).over(w)).withColumn("_left", F.sum(1 - c("_side")).over(w))
    both = both.withColumn("_n", F.when(c("_side") == 0, c("_left")).otherwise(c("_all") - c("_left")))
    met = both.groupBy(*keys, "_n").agg(F.max(F.when(c("_side") == 0, c("id"))).alias("l"), F.max(F.when(c("_side") == 1, c("id"))).alias("r"))
    return met.select("l", "r").filter("l IS NOT NULL AND r IS NOT NULL")


def mutual_best(candidates: DataFrame, order: list[Column]) -> DataFrame:
    """l, r: what taking the best candidate again and again gives, each l and each r used once.

    The order is made total by l and r, so the best candidate left is the best of both its ends. In each round all candidates that are the best of
    both ends are taken, and their ends go; the result is that of the sequential choice, in far fewer steps. A round shuffles the candidates three
    times and is staged once.
    """
    c = F.col
    left = stage(candidates.select("l", "r", F.struct(*[x.alias(f"o{i}") for i, x in enumerate(order)], "l", "r").alias("o")).distinct())
    by_l, by_r = W.partitionBy("l"), W.partitionBy("r")
    taken = None
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            return taken if taken is not None else left.select("l", "r")
        best = (c("o") == c("_l")) & (c("o") == c("_r"))
        marked = left.withColumn("_l", F.min("o").over(by_l)).withColumn("_r", F.min("o").over(by_r)).withColumn("_best", best)
        # an end that is taken takes its other candidates with it; rows lie by r already
        marked = marked.withColumn("_gone", F.max("_best").over(by_r)).withColumn("_gone", c("_gone") | F.max("_best").over(by_l))
        round_ = stage(marked.filter("_best OR NOT _gone").select("l", "r", "o", "_best"))
        found, left = round_.filter("_best").select("l", "r"), round_.filter("NOT _best").select("l", "r", "o")
        taken = found if taken is None else taken.unionByName(found)
    raise RuntimeError(f"candidates are left after {MOST_ROUNDS} rounds")


def without(df: DataFrame, pairs: DataFrame, end: str) -> DataFrame:
    """Rows whose id is not yet an end of a pair."""
    return df.join(pairs.select(F.col(end).alias("id")), "id", "left_anti")
