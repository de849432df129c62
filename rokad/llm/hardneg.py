"""Hard negatives by a secondary-sort shuffle.

Scores of pairs (anchor, row) are integer inner products, made in tiles of a block of rows and a set of anchors. What leaves a tile are
packed keys (anchor, descending score, positives first, id). They are dealt by anchor and sorted within partitions, so an iterator
that holds a few open windows reads an anchor's pairs once, in order: a positive opens a window below its score, the negatives that follow fall
into the open windows until they are full or the score has left them. No anchor's pairs are gathered.

The shuffle runs twice. First every tile sends each anchor's best rows of the same label, and the stream takes the first of them: the
positives. Their scores then go to the tiles as windows, and every tile sends what it has of each window, its first few rows, which hold
the first few of all tiles. So a tile sends a bounded number of keys per anchor and no row that could be in the result stays behind.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this percentage of the positive's, and not above it.
LEAST_PERCENT = 80
#: What components are multiplied by before they are cut to whole numbers.
SCALE = 256
LABELS = 10
#: Rows of a block at most; fewer, down to LEAST_BLOCK, while there are fewer blocks than tasks. Products of so many rows and columns at once.
BLOCK = 65_536
LEAST_BLOCK = 2048
ROWS, COLUMNS = 512, 8192
#: Squared length below which every score, and 100 times it, is a whole number that fits a long.
MOST_SQUARE = float(1 << 56)
KEYS = "anchor_id long, below long, kind int, id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (whole numbers as doubles), dim of the rows that take part.

    Rows without id, label or vector and those with a null or non-finite component take no part; nor do rows whose whole-number vector has a
    squared length of 2^56 or more, whose scores a long may not hold. Labels of ids divisible by 7 move on by one.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    own = own.filter("vec_id is not null and label is not null and e is not null")
    own = own.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # floor() of a double is a long in Spark, which the largest components do not fit; such rows go by their length before
    own = own.filter(F.aggregate("e", F.lit(0.0), lambda t, x: t + x * x) * SCALE * SCALE < 4 * MOST_SQUARE)
    own = own.withColumn("v", F.transform("e", lambda x: F.floor(x * SCALE).cast("double")))
    own = own.filter(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x) < MOST_SQUARE)
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    return own.select("vec_id", label.alias("label"), "v", F.size("v").alias("dim"))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    longest = np.sqrt((a * a).sum(1).max()) * np.sqrt((b * b).sum(1).max())
    if longest < 1 << 52:  # so is every partial sum, and doubles are exact
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def first_of(score: np.ndarray, ids: np.ndarray, pick: np.ndarray, k: int) -> np.ndarray:
    """The first k of the picked positions by descending score, ties by smaller id."""
    if len(pick) > k:
        own = score[pick]
        pick = pick[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return pick[np.lexsort((ids[pick], -score[pick]))[:k]]


def _tile(choose, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
    """Packed keys of one block of rows and one set of anchors; choose gives the positions kept from one anchor's scores."""
    kept: list[tuple[np.ndarray, ...]] = []
    if len(x) and len(q):
        ids, labels, rows = x.vec_id.to_numpy(), x.label.to_numpy(), np.stack(x.v.to_list())
        asked, own_labels, queries = q.vec_id.to_numpy(), q.label.to_numpy(), np.stack(q.v.to_list())
        windows = q.windows.to_list() if "windows" in q else [None] * len(q)
        for top in range(0, len(q), ROWS):
            for left in range(0, len(x), COLUMNS):
                part = slice(left, left + COLUMNS)
                block = scores(queries[top: top + ROWS], rows[part])
                for i, score in enumerate(block, top):
                    pick = choose(score, ids[part], labels[part], asked[i], own_labels[i], windows[i])
                    if len(pick):
                        kept.append((np.full(len(pick), asked[i]), -score[pick], ids[part][pick]))
    columns = [np.concatenate(c) for c in zip(*kept, strict=True)] if kept else [np.array([], np.int64)] * 3
    return pd.DataFrame(dict(zip(("anchor_id", "below", "id"), columns, strict=True)))


def _keys(data: DataFrame, anchors: DataFrame, choose, kind: int, block: int) -> DataFrame:
    """Packed keys (anchor, descending score, kind, id) from all tiles of one dimension."""
    tasks = data.sparkSession.sparkContext.defaultParallelism
    n, nq = data.count(), anchors.count()
    blocks, sets = max(1, -(-n // block), min(tasks, -(-n // LEAST_BLOCK))), max(1, -(-nq // block))
    left = data.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    right = anchors.withColumn("set", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sets)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def tile(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _tile(choose, x, q)

    key = ["dim", "block", "set"]
    made = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(tile, "anchor_id long, below long, id long")
    return made.select("anchor_id", "below", F.lit(kind).alias("kind"), "id")


def _in_order(keys: DataFrame) -> DataFrame:
    """The secondary sort: dealt by anchor, sorted by the whole key within partitions."""
    return keys.repartition("anchor_id").sortWithinPartitions("anchor_id", "below", "kind", "id")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * (schema.count(",") + 1)
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "int" else pa.int64()) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int, int, int, int]]:
    """(last of its batch, anchor, score, kind, id) of sorted keys, one after another."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for i, (anchor, below, kind, own) in enumerate(zip(*columns, strict=True)):
            yield i + 1 == batch.num_rows, anchor, -below, kind, own


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hard negatives of every anchor and positive.

    vectors and anchors have vec_id, embedding and label (see usable for rows that take no part). Rows that repeat an id are candidates each and
    one anchor (the least by label and vector); rows with the anchor's own id are none of its candidates. Only vectors of one dimension
    meet. An anchor without another row of its label, and a positive with an empty window (every one with a score below zero), give
    no row. Other columns are ignored; an empty side gives an empty result.
    """
    data = stage(usable(vectors))
    asked = stage(usable(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "dim", "v")).alias("row")).select("vec_id", "row.*"))

    def same_label(score, ids, labels, own, label, _):
        return first_of(score, ids, np.flatnonzero((labels == label) & (ids != own)), positives)

    def first_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        anchor, taken = None, 0
        for last, now, score, kind, own in _pairs(batches):
            if now != anchor:
                anchor, taken = now, 0
            if taken < positives:
                out.append((anchor, -score, kind, own))
                taken += 1
            if last:
                yield _batch(out, KEYS)
                out.clear()

    opened = stage(_in_order(_keys(data, asked, same_label, 0, block)).mapInArrow(first_positives, KEYS))
    windows = opened.groupBy("anchor_id").agg(F.sort_array(F.collect_set(-F.col("below")), asc=False).alias("windows"))
    windowed = stage(asked.join(windows, asked["vec_id"] == windows["anchor_id"]).drop("anchor_id"))

    def other_labels(score, ids, labels, own, label, tops):
        low = 100 * score
        fits = np.flatnonzero((labels != label) & (ids != own) & (score <= tops[0]) & (low >= least_percent * min(tops)))
        found = [first_of(score, ids, fits[(score[fits] <= top) & (low[fits] >= least_percent * top)], negatives) for top in tops]
        return np.unique(np.concatenate(found))

    def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        anchor, windows = None, []
        for last, now, score, kind, own in _pairs(batches):
            if now != anchor:
                anchor, windows = now, []
            if kind == 0:
                windows.append([own, score, 0])
            elif windows:
                for window in windows:
                    if window[2] < negatives and 100 * score >= least_percent * window[1]:
                        window[2] += 1
                        out.append((anchor, window[0], window[2], own, window[1], score))
                # later scores are no higher: a window left behind or full stays so
                windows = [w for w in windows if w[2] < negatives and 100 * score >= least_percent * w[1]]
            if last:
                yield _batch(out, RESULT)
                out.clear()

    keys = _keys(data, windowed, other_labels, 1, block).unionByName(opened)
    return _in_order(keys).mapInArrow(open_windows, RESULT)
