"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter answers for all languages at once: every position holds a mask with one bit per language, an n-gram sets
its languages' bits at its positions, and the AND of the masks at an n-gram's positions is the set of languages that (seem to)
contain it. Per language, the hits of a text's n-grams are counted; as a language's slice reports an absent n-gram with
a known chance, fill ** HASHES, the count is corrected for it. The largest corrected count decides.

N-grams are runs of 2 to 4 characters of the lower-cased text, in which anything but letters is one blank.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import forget, mix, stage

SIZES = (2, 3, 4)
HASHES = 3
#: Bounds of the model: labelled documents read per language (about), n-grams kept per language, filter positions per n-gram kept.
SAMPLE = 2000
GRAMS = 6000
POSITIONS = 16
#: An n-gram belongs to a language if this share of its documents has it, and at least this share of what the most typical language shows.
SHARE = 0.004
TYPICAL = 0.34
UNKNOWN = "und"
#: Characters that one numpy pass takes; longer texts are passed in slices.
SLICE = 200_000

_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case (where that is one letter), or a blank if it is no letter; and whether it is a letter."""
    if not _TABLES:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        lower = np.where(letter, np.arange(0x110000), 32).astype(np.uint32)
        for i in np.flatnonzero(letter):
            if len(low := chr(i).lower()) == 1:
                lower[i] = ord(low)
        _TABLES.extend([lower, letter])
    return _TABLES[0], _TABLES[1]


def slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about SLICE characters, as (index of text, part of text)."""
    at, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, len(text or ""), SLICE):
            part = text[start: start + SLICE]
            at.append(i)
            parts.append(part)
            size += len(part)
            if size >= SLICE:
                yield at, parts
                at, parts, size = [], [], 0
    if parts:
        yield at, parts


def grams(parts: list[str], sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: hashes, and the part that each came from. Code point 0 parts the texts and is in no n-gram."""
    lower, _ = _tables()
    raw = "\x01".join(p.replace("\x01", " ") for p in parts)
    points = np.frombuffer(f" {raw} ".replace("\x01", " \x01 ").encode("utf-32-le", "surrogatepass"), np.uint32)
    cut = points == 1
    codes = lower[points]
    codes[cut] = 0
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes, cut = codes[keep], cut[keep]
    part = np.cumsum(cut, dtype=np.int32)
    wide = codes.astype(np.uint64)
    for n in sizes:
        if len(wide) < n:
            continue
        h = np.full(len(wide) - n + 1, n, np.uint64)
        bad = np.zeros(len(h), bool)
        for j in range(n):
            piece = slice(j, len(wide) - n + 1 + j)
            h = h * np.uint64(0x100000001B3) + wide[piece]
            bad |= cut[piece]
        yield mix(h)[~bad], part[: len(h)][~bad]


@dataclass
class Model:
    """Bit-sliced filter: masks[word][position] holds the bits of 64 languages; fill is each language's share of set positions."""

    languages: list[str]
    masks: list[np.ndarray]
    fill: np.ndarray

    @classmethod
    def build(cls, languages: list[str], hashes: np.ndarray, owner: np.ndarray, positions: int = POSITIONS) -> Model:
        size = 1 << 12
        while size < positions * max(1, len(np.unique(hashes))):
            size *= 2
        masks, fill = [], []
        for word in range(0, max(1, len(languages)), 64):
            kind = np.uint8 if len(languages) <= 8 else np.uint64
            own = np.zeros(size, kind)
            for bit in range(min(64, len(languages) - word)):
                for at in cls.places(hashes[owner == word + bit], size):
                    own[at] |= kind(1 << bit)
                fill.append(float(((own >> kind(bit)) & kind(1)).mean()))
            masks.append(own)
        return cls(languages, masks, np.array(fill))

    @staticmethod
    def places(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
        first, second = h & np.uint64(size - 1), (h >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield (first + np.uint64(i) * second) & np.uint64(size - 1)

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language, n-grams that the filter reports; per text, n-grams in all."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at, parts in slices(texts):
            index = np.array(at)
            for h, part in grams(parts):
                np.add.at(total, index, np.bincount(part, minlength=len(parts)))
                places = list(self.places(h, len(self.masks[0])))
                for word, own in enumerate(self.masks):
                    found = own[places[0]]
                    for p in places[1:]:
                        found = found & own[p]
                    for bit in range(min(64, len(self.languages) - 64 * word)):
                        one = np.bincount(part[(found >> own.dtype.type(bit)) & own.dtype.type(1) == 1], minlength=len(parts))
                        np.add.at(hits[:, 64 * word + bit], index, one)
        return hits, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score: the winner's share of all corrected counts; `und` and 0 for texts without a letter."""
        lettered = [bool(t) and (t.isalpha() or any(c.isalpha() for c in t)) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        hits, total = self.count(texts)
        wrong = self.fill ** HASHES
        true = np.maximum(0, (hits - total[:, None] * wrong) / np.maximum(1e-9, 1 - wrong))
        best, whole = true.argmax(1), true.sum(1)
        score = np.where(whole > 0, true.max(1) / np.maximum(whole, 1e-9), 0.0)
        return ([self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0))


def held_out() -> Column:
    """crc32 of the id as text leaves 0 when divided by 5; a null id is neither learned from nor held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, kept: int = GRAMS) -> Model:
    """A model from text and lang of docs: about `sample` documents per language, chosen by a hash of the id, `kept` n-grams each.

    Languages are ordered by number of documents, so that ties go to the more frequent one. Null texts and labels are passed over.
    """
    rows = docs.filter("text is not null and lang is not null")
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r.lang for r in found]
    if not languages:
        return Model.build([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    index = {lang: i for i, lang in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for r in found for x in (r.lang, min(1.0, sample / r["count"]))])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            for at, parts in slices(texts):
                for h, part in grams(parts):
                    order = np.lexsort((h, part))
                    h, part = h[order], part[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
                    h, own = h[new], langs[np.array(at)][part[new]]
                    for lang in np.unique(own):
                        gram, n = np.unique(h[own == lang], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), lang, np.int64)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    per = chosen.groupBy("lang").count().collect()
    read = F.create_map(*[F.lit(x) for r in per for x in (index[r.lang], float(r["count"]))]) if per else None
    if read is None:
        return Model.build([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    counts = chosen.mapInArrow(count, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    shares = counts.select("lang", "gram", (F.col("n") / F.element_at(read, F.col("lang").cast("int"))).alias("share")).filter(F.col("share") >= SHARE)
    shares = stage(shares)
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    own = shares.join(most, "gram").filter(F.col("share") >= TYPICAL * F.col("most"))
    first = own.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "gram"))).filter(F.col("no") <= kept)
    model = first.select("lang", "gram").toArrow()
    return Model.build(languages, model.column(1).to_numpy().view(np.uint64), model.column(0).to_numpy())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (0 to 1), replaced if they were there.

    Null texts and texts without a letter are `und` with score 0; so are all texts under a model without languages. A lettered text
    without a known n-gram gets the most frequent language, with score 0. Every row is answered from its own whole text alone.
    """
    kept = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            lang, score = sent.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(own.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(own.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
