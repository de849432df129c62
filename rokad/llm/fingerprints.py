"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A fingerprint is the k least of a text's distinct shingle hashes, eight big-endian bytes each, in base64. Sketches of parts merge to
the sketch of the whole; two of them estimate resemblance and containment, one alone the number of distinct shingles.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resemblance, shingles

SHINGLE = 5
KEPT = 128
#: Documents in one id range of the edited-text pass, a few MB of text; more where RANGES would be passed.
RANGE_DOCS = 500
RANGES = 65_536
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_shingles_estimate double")


def sketch(text: str | None, size: int = SHINGLE, k: int = KEPT) -> np.ndarray:
    return shingles(text, size)[:k]


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = KEPT) -> np.ndarray:
    """Sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def distinct_count(s: np.ndarray, k: int = KEPT) -> float:
    """Estimated number of distinct shingles: exact below k, else from how low the k-th value lies."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = KEPT) -> float:
    """Estimated share of the shingles of a that b has (1 for an empty a)."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, shared / distinct_count(a, k))


def fingerprint(docs: DataFrame, k: int = KEPT, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, n_shingles_estimate of every row; null and word-free texts have the empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [sketch(t, size, k) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(s) for s in kept], pa.string()),
                                              pa.array([distinct_count(s, k) for s in kept], pa.float64())],
                                             names=["doc_id", "fingerprint", "n_shingles_estimate"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string, n_shingles_estimate double")


def edited_likeness(docs: DataFrame, k: int = KEPT, size: int = SHINGLE) -> DataFrame:
    """Fingerprint of every text and of its edit: the last half (rounded down) of its code points replaced by as many first ones
    of the next document in ascending doc_id (after the last: the first).

    Null text counts as empty. Repeated ids are ordered by their text; rows without id come last, by text. A single
    document is its own next. Two empty fingerprints are alike (1), an empty and another are not (0). Other columns are ignored.

    Documents are cut into ranges that begin at existing ids. The first document of a range also goes, as a guard, to the
    end of the range before, so that every row meets its next one in its own task, and texts move once.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = own.count()
    ranges = min(RANGES, max(1, -(-n // RANGE_DOCS)))
    shares = [i / ranges for i in range(ranges)] if ranges > 1 else [0.0]
    # percentile_approx returns values of the column; one value per range, so RANGES at most
    bounds = sorted(set(own.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * ranges)).alias("b"), F.min("doc_id").alias("m"))
                        .select(F.array_union(F.array("m"), F.coalesce("b", F.array().cast("array<bigint>"))).alias("b")).first()["b"]) - {None})
    starts = np.array(bounds, np.int64)
    last = max(0, len(bounds) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            absent = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            plain = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            at = np.clip(np.searchsorted(starts, plain, "right") - 1, 0, last)
            at[absent] = last
            first = np.flatnonzero(~absent & np.isin(plain, starts)) if len(starts) else np.array([], np.int64)
            before = np.where(at[first] == 0, last, at[first] - 1)
            rows = np.concatenate([np.arange(len(at)), first])
            moved = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([at, before]), pa.int64()), pa.array(np.r_[np.zeros(len(at), np.int32), np.ones(len(first), np.int32)]),
                pa.array(np.concatenate([absent, np.zeros(len(first), bool)])), moved.column(0), moved.column(1)],
                names=["range", "guard", "no_id", "doc_id", "text"])

    placed = own.mapInArrow(place, "range long, guard int, no_id boolean, doc_id long, text string")
    ordered = placed.repartition(F.col("range")).sortWithinPartitions("range", "guard", "no_id", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: tuple[int, int | None, str, np.ndarray] | None = None
        first: tuple[str, np.ndarray] | None = None  # of the range, for a range that is alone and has no id
        done = False  # the guard of this range was used

        def finish(text: str, kept: np.ndarray) -> None:
            half = len(held[2]) // 2
            edited = held[2][: len(held[2]) - half] + text[:half]
            changed = sketch(edited, size, k)
            out.append((held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), to_text(held[3]), to_text(changed),
                        resemblance(held[3], changed, k), resemblance(held[3], kept, k), distinct_count(held[3], k)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for at, guard, doc_id, text in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
                if held is not None and held[0] != at:
                    if not done:
                        finish(*first)
                    held, first, done = None, None, False
                if guard and done:
                    continue
                kept = sketch(text, size, k)
                if held is not None:
                    finish(text, kept)
                if guard:
                    done = True
                    continue
                first = first or (text, kept)
                held = (at, doc_id, text, kept)
            yield flush()
        if held is not None and not done:
            finish(*first)
        yield flush()

    return ordered.mapInArrow(run, SCHEMA)
