"""Helpers shared by the training-data operators: reading, staging, word and shingle hashes, sketches."""
from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Arrow hands to Python at once; texts are long, so fewer than Spark's default.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; the session settings the Python stages count on are set here."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only on one machine where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-rokad-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """df with the 0-based position of each row in the given order, without one task for all rows.

    Rows are range-partitioned and staged; each partition's start is the count of the ones before it,
    a table of one row per partition.
    """
    part, row = "__rk_part", "__rk_row"
    placed = stage(df.orderBy(*order).withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()))
    counts = placed.groupBy(part).agg(F.count("*").alias("__rk_n"), F.min(row).alias("__rk_first"))
    before = counts.select(F.col(part).alias("__rk_p"), F.col("__rk_n").alias("__rk_before"))
    starts = (
        counts.join(F.broadcast(before), F.col("__rk_p") < F.col(part), "left")
        .groupBy(part, "__rk_first").agg(F.coalesce(F.sum("__rk_before"), F.lit(0)).alias("__rk_start"))
    )
    return (
        placed.join(F.broadcast(starts), part)
        .withColumn(name, F.col("__rk_start") + F.col(row) - F.col("__rk_first"))
        .drop(part, row, "__rk_first", "__rk_start")
    )


# ---------------------------------------------------------------- words, shingles, sketches (inside tasks)

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values whose outputs look random."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


#: Keys (bytes or text) longer than this are not remembered, which bounds a cache in bytes too.
LONG_KEY = 64


class Recent(dict):
    """Values made on demand and remembered in two generations of bounded size, so that frequent keys stay; long keys are not."""

    made: list[Recent] = []

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}
        Recent.made.append(self)

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONG_KEY:
            return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: glibc's call that returns freed memory to the system, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def forget() -> None:
    """Empty all caches of this process and return what is free: a worker that turns to another operator gives their memory back."""
    if any(Recent.made):
        for cache in Recent.made:
            cache.clear()
            cache.old = {}
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


#: Bytes of texts or sets that a task turns into Python objects at once.
BATCH_BYTES = 8 << 20


def small_batches(batches, *columns: int, most: int = BATCH_BYTES):
    """The same rows in batches whose given columns (text or binary) hold at most that many bytes, one row at least."""
    for batch in batches:
        ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
            yield batch.slice(low, high - low)
            low = high


_HASHES = Recent(xxhash.xxh3_64_intdigest, 150_000)


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; fewer words count as one run; no word gives none."""
    h = word_hashes(words_of(text))
    if not len(h):
        return h
    run = min(size, len(h))
    acc = np.full(len(h) - run + 1, run, np.uint64)
    for j in range(run):
        acc = mix((acc + h[j: len(h) - run + 1 + j]) * _MULTIPLY)
    return np.unique(acc)


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Jaccard similarity estimated from two sorted bottom-k sketches: shared values among the k least of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


# ---------------------------------------------------------------- ids and components

#: Ids sent to every task; beyond it the same choice is made by a join.
SENT_IDS = 4_000_000


def choose_by_id(docs: DataFrame, ids: DataFrame, key: str, keep: bool = True, limit: int = SENT_IDS, then=None, schema=None) -> DataFrame:
    """Rows of docs whose key is (keep) or is not among the distinct ids, without moving texts while the ids are few.

    then turns the chosen batches into rows of schema, in the same Python worker.
    """
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias("__rk_id")).filter("__rk_id is not null")
    if ids.count() > limit:
        chosen = docs.join(ids, docs[key] == ids["__rk_id"], "left_semi" if keep else "left_anti")
        return chosen.mapInArrow(then, schema) if then else chosen
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column(0).to_numpy()))
    at = docs.columns.index(key)

    def run(batches):
        known = sent.value
        for batch in batches:
            own = batch.column(at)
            value = own.fill_null(0).to_numpy(zero_copy_only=False)
            spot = np.searchsorted(known, value)
            found = (spot < len(known)) & (known[np.minimum(spot, len(known) - 1)] == value) if len(known) else np.zeros(len(value), bool)
            found &= ~own.is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(found if keep else ~found))

    if then:
        return docs.mapInArrow(lambda batches: then(run(batches)), schema)
    return docs.mapInArrow(run, docs.schema)


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node reachable over the edges (a, b), for every node that has one.

    Alternating star contractions: each round hangs every larger neighbour of a node, then the node itself, on the least one
    near it. Rounds are few (log squared of the largest component) and each one is staged.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        check = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(check) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(check)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = stage(small.filter("u <> v").distinct())
