"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same number of copies q = target / source size, which is rounded so that the
words taken stay at the source's target: a document and the rest of its group exchange copies, weighed in words, at random
(what one gains, the other loses; in expectation nothing) until one of them is integral. Documents are
dealt to leaves of at most about LEAF by hash; a leaf goes from its largest document to its smallest and leaves one small
document undecided. Those residuals meet in the next level of a tree of fan-in LEAF, the last of which is rounded by itself,
so a source misses its target by less than one of its small documents.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, with_rank

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
LEAF = 2048
WORD = r"[^\x20\x09-\x0D]+"
ROWS = "doc_id long, source string, size long, source_size long, target double, base int, p double, u double, copies int"


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, docs, source_size, target: weights repeat over the sources by code point, null last; a target stops at `most` times the
    source's size, and what is over goes to the others by weight, until none is above."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = with_rank(per, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.withColumn("weight", weight.cast("double")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap, level, capped = F.col("source_size") * float(most), 0.0, -1
    while True:
        full = cap <= level * F.col("weight")
        now = ranked.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("filled"), F.count(F.when(full, 1)).alias("n"),
                         F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if now.n == capped or not now.w:
            break
        capped, level = now.n, (share * total - now.filled) / now.w
    return ranked.select("source", "docs", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _settle(size: np.ndarray, q: float, most: float, u: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Round equal copy numbers q, 0 to most, of documents in falling size: copies of each, and the one left undecided with its number (or -1).

    A document goes to a whole number next to its own; the rest of the group, at one common number, takes up what it gains or loses.
    """
    x = np.zeros(len(size))
    rest = np.append(np.cumsum(size[::-1])[::-1][1:], 0).astype(float)
    for i in range(len(size)):
        down_to = np.floor(q + 1e-12)
        over = q - down_to
        if over <= 1e-12:
            x[i:] = down_to
            return x, -1, 0.0
        s, r = float(size[i]), rest[i]
        if r == 0:
            return x, i, q
        up, down = min((1 - over) * s, q * r), min(over * s, (most - q) * r)
        step = up if u[i] * (up + down) < down else -down
        own, q = q + step / s, q - step / r
        x[i] = np.rint(own)
        if abs(own - x[i]) > 1e-12:
            x[i + 1:] = np.rint(q)
            return x, i, own
    return x, -1, 0.0


def _pair_off(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int, float]:
    """The same for differing probabilities: each document meets the undecided one before it."""
    x, held = p.copy(), -1
    for i in range(len(size)):
        if x[i] <= 1e-12 or x[i] >= 1 - 1e-12:
            x[i] = round(x[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = float(size[held]), float(size[i])
        up, down = min((1 - x[held]) * a, x[i] * b), min(x[held] * a, (1 - x[i]) * b)
        step = up if u[i] * (up + down) < down else -down
        x[held], x[i] = x[held] + step / a, x[i] - step / b
        left = [j for j in (held, i) if 1e-12 < x[j] < 1 - 1e-12]
        for j in {held, i} - set(left):
            x[j] = round(x[j])
        held = left[0] if left else -1
    return x, held, float(x[held]) if held >= 0 else 0.0


def _level(leaf: bool, last: bool, most: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "u", "doc_id"], ascending=[not leaf, True, True], kind="stable").reset_index(drop=True)
        size, u, base, p = (pdf[c].to_numpy() for c in ("size", "u", "base", "p"))
        if leaf:
            x, held, left = _settle(size, float(base[0] + p[0]), most, u)
        else:
            x, held, left = _pair_off(size, p, u)
            x, left = x + base, left + base[held]
        out = pdf.assign(copies=pd.array(np.rint(x).astype("int64"), "Int32"))
        if held >= 0:
            whole = int(left)
            out.loc[held, "base"], out.loc[held, "p"] = whole, left - whole
            out.loc[held, "copies"] = whole + int(u[held] < left - whole) if last else pd.NA
        return out[[c.split()[0] for c in ROWS.split(", ")]]
    return run


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, leaf: int = LEAF) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies, source of every row.

    Null text has size 0; documents of size 0 are taken without words (copies of the whole part only). A null source is a source of its own,
    last in order. Repeated rows and null ids are rows like others. Ties in size go by a hash of id and seed, so reruns
    agree. Other columns are ignored; an empty table gives an empty result.
    """
    sizes = stage(sized(docs))
    targets = source_targets(sizes, share, most, weights)
    q = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    nearest = F.round(q)
    q = F.when(F.abs(q - nearest) < 1e-12, nearest).otherwise(q)
    base = F.floor(q).cast("int")
    plan = targets.select(F.col("source").alias("__rk_s"), "docs", "source_size", "target", base.alias("base"), (q - base).alias("p"))
    rows = sizes.join(plan, sizes["source"].eqNullSafe(plan["__rk_s"])).drop("__rk_s")
    key = F.xxhash64("doc_id", "source", "size", F.lit(seed))
    rows = rows.withColumn("u", F.pmod(key, F.lit(1 << 30)) / float(1 << 30)).withColumn("copies", F.lit(None).cast("int"))
    names = [c.split()[0] for c in ROWS.split(", ")]
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    done = rows.filter(~open_).withColumn("copies", F.col("base")).select(names)
    leaves = F.ceil(F.col("docs") / leaf)
    dealt = rows.filter(open_).withColumn("leaf", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), leaves)).select(*names, "leaf")
    wide = -(-(targets.agg(F.max("docs")).first()[0] or 0) // leaf)
    now = stage(dealt.groupBy("source", "leaf").applyInPandas(_level(True, False, most), ROWS))
    while True:
        done = done.unionByName(now.filter("copies is not null"))
        groups = max(1, -(-wide // leaf))
        left = now.filter("copies is null").withColumn("leaf", F.pmod(F.xxhash64("doc_id", F.lit(seed + 2)), F.lit(groups)))
        now = left.groupBy("source", "leaf").applyInPandas(_level(False, groups == 1, most), ROWS)
        if groups == 1:
            break
        now, wide = stage(now), groups
    out = done.unionByName(now)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "source")


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs with every row repeated as often as its copies in mixed; rows without a copy go. Rows of one id are matched by size."""
    order = Window.partitionBy("__rk_id").orderBy("__rk_size")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    left = docs.withColumn("__rk_id", F.col("doc_id").cast("long")).withColumn("__rk_size", size).withColumn("__rk_no", F.row_number().over(order))
    right = mixed.select(F.col("doc_id").alias("__rk_id"), F.col("size").alias("__rk_size"), "copies")
    right = right.withColumn("__rk_no", F.row_number().over(order)).select(F.col("__rk_id").alias("__rk_to"), F.col("__rk_no").alias("__rk_to_no"), F.col("copies").alias("__rk_copies"))
    met = left.join(right, left["__rk_id"].eqNullSafe(right["__rk_to"]) & (left["__rk_no"] == right["__rk_to_no"])).filter("__rk_copies > 0")
    return met.withColumn("__rk_copy", F.explode(F.sequence(F.lit(1), F.col("__rk_copies")))).select(*docs.columns)
