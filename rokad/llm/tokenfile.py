"""Token ids in ORC files, in ascending doc_id order.

Texts are dealt into id ranges, sorted, encoded and written by Spark's ORC writer: ids as integers with run-length encoding, stripes
that tasks can read apart, row indexes (least and greatest value of every ROWS_INDEXED rows) and Bloom filters on doc_id. A reader that asks for
some documents skips the stripes and row groups that cannot hold them. Rows carry the number of their file in id order and the ids before
them in it, so that any stripe can be read alone; the starts of files are one sum per file.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, small_batches
from .tokens import WORD_BPE, encoder

END_ID = 1
STRIPE_BYTES = 32 << 20
ROWS_INDEXED = 1000
BLOOM_WRONG = 0.01
FILE_SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = END_ID) -> None:
    """Write the ids of every text, with end_id after each, as ORC files in ascending doc_id order, rows without id first.

    Null text counts as empty. Repeated ids are ordered by their text's hash; equal rows are dealt over several files where they are many,
    as a salt by their place in the input comes last. Other columns are ignored; an empty table writes files without rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("salt")]
    placed = own.select(*keys, "text").repartitionByRange("doc_id", "tie", "salt").sortWithinPartitions("doc_id", "tie", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, 1):
            ids, sizes = enc.encode_batch(batch.column(1))
            # every document's end id goes behind its own ids
            ids = np.insert(ids, np.cumsum(sizes), end_id).astype(np.int32)
            sizes = sizes + 1
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(at + ends - sizes), pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids))],
                names=[x.split()[0] for x in FILE_SCHEMA.split(", ")])
            at += int(ends[-1])

    options = {"orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": ROWS_INDEXED, "orc.create.index": True, "orc.bloom.filter.columns": "doc_id",
               "orc.bloom.filter.fpp": BLOOM_WRONG, "compression": "zstd"}
    placed.select("doc_id", "text").mapInArrow(run, FILE_SCHEMA).write.options(**{k: str(v) for k, v in options.items()}).orc(path)


def read_tokens(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """doc_id, part, at, n_tokens, ids of the files' rows; a condition on doc_id prunes stripes and row groups by their statistics and Bloom filters."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if wanted is None else rows.filter(wanted)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, before: the ids of all files before each, from two columns of the files; one row per file."""
    sums = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def token_rows(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the rows that the files hold; counts and digests come from the ids read."""
    schema = "doc_id long, part int, at long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            sums = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                                             names=[x.split()[0] for x in schema.split(", ")])

    read = read_tokens(spark, path, wanted).select("doc_id", "part", "at", "ids").mapInArrow(run, schema)
    return read.join(file_starts(spark, path), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_report(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """Write docs as ORC files in a new folder of the shared folder and return what they hold: doc_id, start, n_tokens, ids_crc32 per row."""
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return token_rows(spark, path)
