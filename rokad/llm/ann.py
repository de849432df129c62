"""Exact nearest neighbours by a block matrix join with int8 tiles.

Candidates and queries are dealt into blocks by hash; a tile is one block of each. In a tile, vectors are quantised to int8 with their own scale,
integer products give all approximate distances, and the lengths of the quantisation residuals bound their error. Only candidates whose
lower bound does not pass the k-th upper bound (or the k-th best so far) are computed again from the original vectors in double
precision. Each tile keeps a heap of k per query; the heaps of a query's tiles are merged by rank.
"""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536
#: Blocks are made smaller, down to this, while there are fewer than tasks.
LEAST_BLOCK = 2048
#: Components beyond these are scaled by a power of two before they are squared.
SMALLEST, LARGEST = 1e-130, 1e130
#: Rows of a tile multiplied at once.
ROWS, COLUMNS = 512, 4096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles), dim of rows that have an id and a vector that is not null, empty or zero and has finite components only."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.filter(finite).filter(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of the quantised vectors, lengths of the residuals; one row per vector."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.sqrt((near * near).sum(1)), np.sqrt(((x - near) ** 2).sum(1))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to one vector, components summed in order."""
    total = np.zeros(len(x))
    for j in range(len(q)):
        total += (x[:, j] - q[j]) ** 2
    return np.sqrt(total)


def search_tile(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, float, int]]:
    """(query, distance, vec_id) of the k nearest of a tile for each query, ties to the smaller id, rows of the query's own id left out."""
    # squares of the largest and of the least doubles leave their range; a power of two changes no digit of what stays inside
    top = max(np.abs(x).max(), np.abs(queries).max())
    if not SMALLEST < top < LARGEST:
        away = 2.0 ** (-600 if top >= LARGEST else 600)
        return [(q, d / away, c) for q, d, c in search_tile(ids, x * away, query_ids, queries * away, k)]
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # products of codes are whole and exact in it
    codes, scale, length, rest = quantise(x)
    qcodes, qscale, qlength, qrest = quantise(queries)
    codes, qcodes = codes.astype(kind), qcodes.astype(kind)
    out: list[tuple[int, float, int]] = []
    for top in range(0, len(queries), ROWS):
        rows = range(top, min(top + ROWS, len(queries)))
        heaps: list[list[tuple[float, int]]] = [[] for _ in rows]
        for left in range(0, len(x), COLUMNS):
            part = slice(left, left + COLUMNS)
            block = qcodes[rows.start: rows.stop] @ codes[part].T
            square = qlength[rows.start: rows.stop, None] ** 2 + length[part] ** 2 - 2 * qscale[rows.start: rows.stop, None] * scale[part] * block
            middle = np.sqrt(np.maximum(square, 0))
            # what double rounding may add: relative to the lengths, under the root where they cancel
            error = qrest[rows.start: rows.stop, None] + rest[part] + 1e-7 * (qlength[rows.start: rows.stop, None] + length[part])
            own = query_ids[rows.start: rows.stop, None] == ids[part]
            upper = np.where(own, np.inf, middle + error)
            bound = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(rows), np.inf)
            for i in range(len(rows)):
                heap = heaps[i]
                limit = min(bound[i], -heap[0][0] if len(heap) == k else np.inf)
                pick = np.flatnonzero((middle[i] - error[i] <= limit) & ~own[i])
                if not len(pick):
                    continue
                far = exact(x[part][pick], queries[rows.start + i])
                near = np.lexsort((ids[part][pick], far))[:k]
                for d, c in zip(far[near].tolist(), ids[part][pick][near].tolist(), strict=True):
                    if len(heap) < k:
                        heapq.heappush(heap, (-d, -c))
                    elif (-d, -c) > heap[0]:
                        heapq.heapreplace(heap, (-d, -c))
        for i, heap in enumerate(heaps):
            out += [(int(query_ids[rows.start + i]), -d, -c) for d, c in heap]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest rows by Euclidean distance, all of them if fewer.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor rows without id. Distances are taken between
    vectors of one dimension only. Rows that repeat an id are candidates each, and one query (the least vector); rows with the query's own
    id are no candidates of it. Other columns are ignored; an empty side gives an empty result.
    """
    data, asked = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min_by("v", F.struct("dim", "v")).alias("v")).withColumn("dim", F.size("v"))
    n, nq = data.count(), asked.count()
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block), min(tasks, -(-n // LEAST_BLOCK)))
    sets = max(1, -(-nq // block))
    data = data.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    asked = asked.withColumn("set", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sets)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def tile(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = search_tile(x.vec_id.to_numpy(), np.stack(x.v.to_list()), q.vec_id.to_numpy(), np.stack(q.v.to_list()), k) if len(x) and len(q) else []
        return pd.DataFrame(found, columns=["query_id", "score", "vec_id"]).astype({"query_id": "int64", "score": "float64", "vec_id": "int64"})

    key = ["dim", "block", "set"]
    heaps = data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(tile, "query_id long, score double, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return heaps.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
