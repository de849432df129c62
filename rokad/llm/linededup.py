"""Reversible line deduplication: exact reference counts per line key, and sharded cuckoo filters of the keys to drop.

The index holds, per 128-bit key hash, the number of documents that have the line, and one cuckoo filter per shard of the hash
space with the keys at or over the threshold. Inserting documents adds to the counts and puts keys that cross the threshold into
their shard's filter; deleting documents subtracts and takes keys that fall below out again, which a Bloom filter could
not do. After any sequence of both, the index equals one built from the documents that remain.
"""
from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stage

SPACE = b" \t\n\r\x0b\x0c"
MIN_DOCS = 10
#: Keys that one filter is planned for; a shard is a range of the hash space.
SHARD_KEYS = 50_000
#: Filters go to every task only when all of them together stay under this.
FILTER_BYTES = 64 << 20
SLOTS = 4


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def key_hashes(text: str | None) -> list[bytes]:
    """128-bit key hash of each line of a text; of an empty key, nothing (b'')."""
    return [xxhash.xxh3_128_digest(k) if (k := line_key(x)) else b"" for x in (text or "").encode().split(b"\n")]


class CuckooFilter:
    """32-bit fingerprints in buckets of four; supports insertion, deletion and vectorised look-up.

    Keys come as (high, low) halves of a 128-bit hash: low gives the first bucket, high the fingerprint.
    """

    def __init__(self, slots: np.ndarray) -> None:
        self.slots = slots
        self.mask = np.uint64(len(slots) - 1)

    @classmethod
    def empty(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * 0.8 < max(keys, 4):
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint32))

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint32).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    @staticmethod
    def marks(high: np.ndarray) -> np.ndarray:
        marks = (high >> np.uint64(32)).astype(np.uint32)
        marks[marks == 0] = 1
        return marks

    def places(self, low: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = low & self.mask
        return first, first ^ (marks.astype(np.uint64) * np.uint64(0x5BD1E995) & self.mask)

    def has(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        marks = self.marks(high)
        a, b = self.places(low, marks)
        wanted = marks[:, None]
        return (self.slots[a] == wanted).any(1) | (self.slots[b] == wanted).any(1)

    def insert(self, high: int, low: int) -> bool:
        """False when the filter is too full; the caller then rebuilds a larger one from the exact counts."""
        marks = self.marks(np.array([high], np.uint64))
        a, b = (int(x[0]) for x in self.places(np.array([low], np.uint64), marks))
        mark, at = marks[0], a
        for bucket in (a, b):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = mark
                return True
        for turn in range(500):
            slot = (turn * 7 + int(mark)) % SLOTS
            mark, self.slots[at, slot] = self.slots[at, slot], mark
            at ^= int(mark) * 0x5BD1E995 & int(self.mask)
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                return True
        return False

    def delete(self, high: int, low: int) -> bool:
        """Take one copy of a key's fingerprint out; only for keys that were inserted."""
        marks = self.marks(np.array([high], np.uint64))
        for bucket in (int(x[0]) for x in self.places(np.array([low], np.uint64), marks)):
            found = np.flatnonzero(self.slots[bucket] == marks[0])
            if len(found):
                self.slots[bucket, found[0]] = 0
                return True
        return False


def shard_of(high, shards: int):
    """Shard of a key: the high half's low 20 bits, which the fingerprint does not use."""
    return (high & 0xFFFFF) % shards


def line_counts(docs: DataFrame) -> DataFrame:
    """high, low, n: number of rows of docs that have each non-empty line key at least once; summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(seen), ">i8").reshape(-1, 2).astype(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(list(seen.values()), pa.int64())], names=["high", "low", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(set(key_hashes(text)) - {b""})
            if len(seen) > 100_000:
                yield rows()
        yield rows()

    return docs.select("text").mapInArrow(run, "high long, low long, n long").groupBy("high", "low").agg(F.sum("n").alias("n"))


class LineIndex:
    """Exact counts (high, low, n) and filters (shard, bits) at one threshold; insert and delete give a new index."""

    def __init__(self, counts: DataFrame, filters: DataFrame, shards: int, min_docs: int) -> None:
        self.counts, self.filters, self.shards, self.min_docs = counts, filters, shards, min_docs

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> LineIndex:
        counts = stage(line_counts(docs))
        full = counts.filter(F.col("n") >= min_docs)
        shards = max(1, -(-full.count() // shard_keys))
        schema = "shard long, bits binary"
        none = docs.sparkSession.createDataFrame([], schema)
        return cls(counts, stage(cls._changed(none, full.select("high", "low", F.lit(1).alias("way")), full, shards)), shards, min_docs)

    @staticmethod
    def _changed(filters: DataFrame, moves: DataFrame, full: DataFrame, shards: int) -> DataFrame:
        """Filters after keys went in (way 1) or out (way -1); a shard that overflows is built anew, larger, from its full keys."""
        def run(key: tuple, old: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            keys = moved[moved.way != 0]
            kept = moved[moved.way == 0]
            f = CuckooFilter.load(old.bits.iloc[0]) if len(old) else CuckooFilter.empty(len(keys))
            rows = list(zip(keys.high.to_numpy().view(np.uint64).tolist(), keys.low.to_numpy().view(np.uint64).tolist(), keys.way.tolist(), strict=True))
            ok = all([f.delete(h, lo) for h, lo, way in rows if way < 0]) and all(f.insert(h, lo) for h, lo, way in rows if way > 0)
            size = max(len(kept), len(keys))
            while not ok:
                size *= 2
                f = CuckooFilter.empty(size)
                ok = all(f.insert(h, lo) for h, lo in zip(kept.high.to_numpy().view(np.uint64).tolist(), kept.low.to_numpy().view(np.uint64).tolist(), strict=True))
            return pd.DataFrame({"shard": [key[0]], "bits": [f.dump()]})

        placed = (moves.unionByName(full.select("high", "low", F.lit(0).alias("way")))
                  .withColumn("shard", F.pmod(F.col("high").bitwiseAND(0xFFFFF), F.lit(shards)).cast("long")))
        return filters.groupBy("shard").cogroup(placed.groupBy("shard")).applyInPandas(run, "shard long, bits binary")

    def _moved(self, docs: DataFrame, sign: int) -> LineIndex:
        delta = line_counts(docs).withColumn("n", F.col("n") * sign).withColumn("was", F.lit(0).cast("long"))
        both = stage(self.counts.withColumn("was", F.col("n")).unionByName(delta).groupBy("high", "low").agg(F.sum("n").alias("n"), F.sum("was").alias("was")))
        counts = both.filter("n > 0").select("high", "low", "n")
        over, was = F.col("n") >= self.min_docs, F.col("was") >= self.min_docs
        moves = both.filter(over != was).select("high", "low", F.when(over, 1).otherwise(-1).alias("way"))
        filters = stage(self._changed(self.filters, moves, counts.filter(over), self.shards))
        return LineIndex(counts, filters, self.shards, self.min_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with these documents added."""
        return self._moved(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index with these documents, inserted before, taken out again."""
        return self._moved(docs, -1)

    def _probe(self) -> tuple[list[CuckooFilter], list[int]] | None:
        """All filters by shard and the sorted keys they wrongly report; None when either is too large to send to every task."""
        spark = self.filters.sparkSession
        if (self.filters.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) > FILTER_BYTES:
            return None
        raw = {r.shard: bytes(r.bits) for r in self.filters.toLocalIterator()}
        filters = [CuckooFilter.load(raw[s]) if s in raw else CuckooFilter.empty(0) for s in range(self.shards)]
        shards, sent = self.shards, spark.sparkContext.broadcast([f.dump() for f in filters])

        def wrong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [CuckooFilter.load(x) for x in sent.value]
            for batch in batches:
                high, low = (batch.column(c).to_numpy().view(np.uint64) for c in (0, 1))
                yield batch.filter(pa.array(probe(held, shards, high, low)))

        rest = self.counts.filter(F.col("n") < self.min_docs).select("high", "low").mapInArrow(wrong, "high long, low long")
        limit = FILTER_BYTES // 256
        false = rest.limit(limit + 1).collect()
        return None if len(false) > limit else (filters, [(r.high, r.low) for r in false])

    def apply(self, docs: DataFrame, report: bool = False) -> DataFrame:
        """docs with lines of full keys taken out of text; with report, doc_id and the counts and digest instead.

        The documents must be in the index. Filters answer for nearly all lines; keys under the threshold that a filter reports
        wrongly are found once in the exact counts and passed over, so the result is exact. Where filters are too many to
        send, lines go to the counts by hash instead, with the same result.
        """
        probed = self._probe()
        if probed is None:
            return self._apply_by_join(docs, report)
        shards = self.shards
        sent = docs.sparkSession.sparkContext.broadcast(([f.dump() for f in probed[0]], frozenset(probed[1])))

        def decide(texts: list[str | None]) -> list[list[bool]]:
            held, wrong = _loaded(sent)
            keys = [key_hashes(t) for t in texts]
            flat = [k for ks in keys for k in ks if k]
            halves = np.frombuffer(b"".join(flat), ">i8").reshape(-1, 2).astype(np.int64)
            hit = probe(held, shards, halves[:, 0].view(np.uint64), halves[:, 1].view(np.uint64)) if len(flat) else np.zeros(0, bool)
            if wrong:
                for i in np.flatnonzero(hit):
                    hit[i] = (int(halves[i, 0]), int(halves[i, 1])) not in wrong
            each = iter(hit.tolist())
            return [[bool(k) and next(each) for k in ks] for ks in keys]

        return _rewritten(docs, report, lambda batch, at: decide(batch.column(at).to_pylist()))

    def _apply_by_join(self, docs: DataFrame, report: bool) -> DataFrame:
        """Full keys' lines by a semi-join on the hash, their numbers gathered per document, then joined back."""
        mark = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.length("text").alias("n"))
        full = self.counts.filter(F.col("n") >= self.min_docs).select("high", "low")

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i, no, k) for i, t in enumerate(batch.column(1).to_pylist()) for no, k in enumerate(key_hashes(t)) if k]
                halves = np.frombuffer(b"".join(k for *_, k in found), ">i8").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, *_ in found], pa.int64())), pa.array([no for _, no, _ in found], pa.int32()),
                                                  pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["mark", "no", "high", "low"])

        schema = "mark struct<id: long, h: long, n: int>, no int, high long, low long"
        hits = docs.select(mark.alias("mark"), "text").mapInArrow(lines, schema).join(full, ["high", "low"], "left_semi")
        dropped = hits.groupBy("mark").agg(F.collect_set("no").alias("__rk_drop"))
        marked = docs.withColumn("__rk_mark", mark)
        joined = marked.join(dropped, marked["__rk_mark"].eqNullSafe(dropped["mark"]), "left").drop("__rk_mark", "mark")

        def decide(batch: pa.RecordBatch, at: int) -> list[list[bool]]:
            gone = [set(x or ()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            return [[i in g for i in range((t or "").count("\n") + 1)] for g, t in zip(gone, batch.column(at).to_pylist(), strict=True)]

        return _rewritten(joined, report, decide, hidden=1)


_LOADED: dict[int, tuple] = {}


def _loaded(sent) -> tuple[list[CuckooFilter], frozenset]:
    """The broadcast filters of this process, unpacked once."""
    if id(sent) not in _LOADED:
        _LOADED.clear()
        _LOADED[id(sent)] = ([CuckooFilter.load(x) for x in sent.value[0]], sent.value[1], sent)
    return _LOADED[id(sent)][:2]


def probe(held: list[CuckooFilter], shards: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each key, whether its shard's filter reports it."""
    hit = np.zeros(len(high), bool)
    at = shard_of(high, shards) if shards > 1 else np.zeros(len(high), np.uint64)
    for s in np.unique(at):
        own = at == s
        hit[own] = held[int(s)].has(high[own], low[own])
    return hit


def _rewritten(docs: DataFrame, report: bool, decide, hidden: int = 0) -> DataFrame:
    """docs without the lines that decide(batch, column of text) marks; hidden columns at the end are left out."""
    names = docs.columns[: len(docs.columns) - hidden]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            gone = decide(batch, at)
            kept = [t if t is None or not any(g) else "\n".join([x for x, y in zip(t.split("\n"), g, strict=True) if not y]) for t, g in zip(texts, gone, strict=True)]
            if report:
                yield pa.RecordBatch.from_arrays([
                    batch.column(names.index("doc_id")), pa.array([len(g) for g in gone], pa.int64()), pa.array([sum(g) for g in gone], pa.int64()),
                    pa.array([hashlib.sha256((t or "").encode()).hexdigest() for t in kept], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
            else:
                columns = batch.columns[: len(names)]
                columns[at] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" if report else docs.select(*names).schema
    return docs.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs without the lines whose key is in at least min_docs rows.

    Null text stays null and counts as one empty line; empty keys are never dropped; a text that loses all lines becomes empty.
    A repeated row counts as one more document. Null ids and other columns pass through. An empty table stays empty.
    """
    return LineIndex.build(docs.select("text"), min_docs).apply(docs)


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row after dedup_lines."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return LineIndex.build(own.select("text"), min_docs).apply(own, report=True)
