"""Stupid-backoff language-model scores of every document under the counts of all other documents.

Documents are dealt into batches by hash. A batch explodes its texts to n-grams, adds up equal ones and sends each hash range (shard) one
row: the sorted n-gram hashes with their counts. A shard adds up the counts of all batches, which is the n-gram count table
partitioned by hash, joins them back to the batches' n-grams and returns the totals. A batch then looks up its texts' n-grams in
its totals, takes each document's own occurrences out, and sums the scores per document.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _MULTIPLY, mix, word_hashes, words_of

ORDER = 2
BACKOFF = 0.4
#: Text bytes per batch, and about as many bytes of n-grams per shard.
BATCH_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def exploded(texts: list[str | None], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text; per n from 1 to order, the hash of each n-gram and the text it is in."""
    each = [word_hashes(words_of(t)) for t in texts]
    sizes = np.array([len(h) for h in each], np.int64)
    h = np.concatenate(each) if each else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(each)), sizes)
    out, acc = [], np.zeros(len(h), np.uint64)
    for n in range(1, order + 1):
        end = len(h) - n + 1
        if end <= 0:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        acc = mix((acc[:end] + h[n - 1:]) * _MULTIPLY + np.uint64(n))
        same = doc[:end] == doc[n - 1:]
        out.append((np.where(same, acc, 0), np.where(same, doc[:end], -1)))
    return sizes, out


def _distinct(grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.concatenate([g[d >= 0] for g, d in grams])


def score_documents(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs), mean_log_score of every row.

    Words lie between ASCII white space, A-Z lower-cased. A word's score is count(n-gram) / count(its first n - 1 words) for the longest n-gram
    up to `order`, within the document, that other rows contain; each shortening costs the factor `backoff`. A word that is in no
    other row scores backoff / words of the other rows (backoff if they have none). Null and word-free texts have 0 words, score 0 and no mean.
    Repeated rows and null ids are rows like others; other columns are ignored; an empty table stays empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.regexp_count("text", F.lit(WORD)).cast("long")).alias("words")).first()
    size, words = total.bytes or 0, total.words or 0
    batches = max(1, -(-size // batch_bytes))
    bits = max(0, (size * order // 2 // batch_bytes).bit_length())
    placed = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 200)), F.lit(batches))).repartition("batch")

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(batch: int, texts: list[str]) -> pa.RecordBatch:
            grams, n = np.unique(_distinct(exploded(texts, order)[1]), return_counts=True)
            shard = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(grams) else np.zeros(0, np.int64)
            ends = np.r_[cut[1:], len(grams)] if len(cut) else cut
            n = n.astype(np.uint32)
            return pa.RecordBatch.from_arrays([
                pa.array(shard[cut]), pa.array(np.full(len(cut), batch, np.int64)), pa.array([grams[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                pa.array([n[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())], names=["shard", "batch", "grams", "n"])

        held, texts = None, []
        for part in parts:
            for batch, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if batch != held and texts:
                    yield send(held, texts)
                    texts = []
                held = batch
                texts.append(text)
        if texts:
            yield send(held, texts)

    def add_up(key: tuple, asked: pa.Table) -> pa.Table:
        asked = asked.combine_chunks()
        parts = [np.frombuffer(x, np.uint64) for x in asked.column("grams").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in asked.column("n").to_pylist()])
        _, place = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.bincount(place, weights=counts).astype(np.uint64)[place]
        ends = np.cumsum([len(p) for p in parts])
        return pa.table({"shard": asked.column("shard"), "batch": asked.column("batch"),
                         "totals": pa.array([totals[e - len(p): e].tobytes() for p, e in zip(parts, ends, strict=True)], pa.binary())})

    def score(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        sizes, grams = exploded(own.text.to_list(), order)
        result = pd.DataFrame({"doc_id": own.doc_id, "n_words": sizes, "log_score": 0.0})
        if not sizes.sum():
            return result.assign(mean_log_score=None)
        known, place = np.unique(_distinct(grams), return_inverse=True)
        totals = np.frombuffer(b"".join(answers.sort_values("shard").totals), np.uint64).astype(np.int64)
        doc = np.concatenate([d[d >= 0] for _, d in grams])
        pair, at, mine = np.unique(doc * len(known) + place, return_inverse=True, return_counts=True)
        others = (totals[place] - mine[at]).astype(float)  # occurrences in other documents, n-gram by n-gram
        start, left = [], 0
        for g, d in grams:
            full = np.full(len(g), -1.0)
            full[d >= 0] = others[left: left + int((d >= 0).sum())]
            left += int((d >= 0).sum())
            start.append(full)
        n_words = int(sizes.sum())
        rest = np.maximum(words - np.repeat(sizes, sizes), 0).astype(float)
        value = np.where(start[0] > 0, np.log(np.maximum(start[0], 1) / np.maximum(rest, 1)), np.log(backoff / np.maximum(rest, 1)))
        for n in range(2, order + 1):
            # the n-gram that ends at word i begins n - 1 before it
            shifted = np.full(n_words, -1.0)
            before = np.full(n_words, 1.0)
            if len(start[n - 1]):
                shifted[n - 1:] = start[n - 1]
                before[n - 1:] = start[n - 2][: n_words - n + 1]
            inside = shifted >= 0
            found = shifted > 0
            longer = np.log(np.maximum(shifted, 1) / np.maximum(before, 1))
            value = np.where(found, longer, np.where(inside, np.log(backoff) + value, value))
        result["log_score"] = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=value, minlength=len(sizes))
        return result.assign(mean_log_score=(result.log_score / result.n_words).where(result.n_words > 0))

    asked = placed.sortWithinPartitions("batch").select("batch", "text", "doc_id").mapInArrow(ask, "shard long, batch long, grams binary, n binary")
    answers = asked.groupBy("shard").applyInArrow(add_up, "shard long, batch long, totals binary")
    return placed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(score, "doc_id long, n_words long, log_score double, mean_log_score double")
