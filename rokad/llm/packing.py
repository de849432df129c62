"""Sum-of-squares packing of token sequences into fixed windows.

Each input partition packs its own documents in one pass. Whole windows are cut off a document's front; what remains goes to the
open window whose new fill level keeps the sum over levels of (number of open windows at that level) squared least. Levels
are LEVEL tokens wide and kept in one array. A window closes when less than LEVEL tokens are free. Open windows are few
(at most OPEN); beyond that, and at the end of a partition, their pieces are poured one after another into full windows, and
the last rest is cut into lengths that are powers of two, which need no padding. Padding is therefore under LEVEL of
every window, and no row moves between tasks.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WORD_BPE, encoder

WINDOW = 4096
END_ID = 2
LEVEL = 16
OPEN = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: (doc_id, start, ids as bytes, doc_tokens)
Piece = tuple[int | None, int, bytes, int]


class Packer:
    """Packs documents in the order they come; closed sequences are lists of pieces."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.level_of = -(-window // LEVEL)
        self.count = np.zeros(self.level_of + 1, np.int64)
        self.at: list[list[tuple[int, list[Piece]]]] = [[] for _ in range(self.level_of + 1)]
        self.open = 0
        self.closed: list[list[Piece]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self.closed.append([(doc_id, start, ids[start * 4: (start + self.window) * 4], total)])
            start += self.window
        if start < total:
            self.place((doc_id, start, ids[start * 4:], total))

    def place(self, piece: Piece) -> None:
        """Put a piece shorter than a window where the sum of squares grows least; ties go to the fullest window."""
        size = len(piece[2]) // 4
        step = size // LEVEL
        # a window of level h holds at most LEVEL * h + LEVEL - 1 tokens
        top = (self.window - size - LEVEL + 1) // LEVEL
        fill, held = 0, []
        if top >= 1:
            now, then = self.count[1: top + 1], self.count[1 + step: top + 1 + step]
            grows = np.where(now > 0, then - now + 1, np.iinfo(np.int64).max)
            if step == 0:
                grows = np.where(now > 0, 0, grows)
            best = top - 1 - int(np.argmin(grows[::-1]))
            # a new window adds 2 n + 1 at its level, a move 2 (then - now) + 2
            if now[best] > 0 and 2 * grows[best] <= 2 * self.count[step] + 1:
                fill, held = self.at[best + 1].pop()
                self.count[best + 1] -= 1
                self.open -= 1
        held = [*held, piece]
        fill += size
        if self.window - fill < LEVEL:
            self.closed.append(held)
            return
        level = fill // LEVEL
        self.at[level].append((fill, held))
        self.count[level] += 1
        self.open += 1
        if self.open > OPEN:
            self.pour()

    def pour(self) -> None:
        """Close every open window: their pieces, fullest windows first, are cut to fill windows without a gap."""
        pieces = [p for windows in reversed(self.at) for _, held in windows for p in held]
        self.count[:] = 0
        self.at = [[] for _ in self.at]
        self.open = 0
        left = sum(len(p[2]) // 4 for p in pieces)
        room, held = 0, []
        for doc_id, start, ids, total in pieces:
            while ids:
                if not room:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    held = []
                take = min(room, len(ids) // 4)
                held.append((doc_id, start, ids[: take * 4], total))
                ids, start, room, left = ids[take * 4:], start + take, room - take, left - take
                if not room:
                    self.closed.append(held)


def pack(docs: DataFrame, tokenizer: str = WORD_BPE, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document: where it lies in its document and in its sequence.

    A document is its text's ids (null text: none) and the end id, so that every row has at least one token. Null and repeated
    ids are packed row by row. Other columns are ignored. An empty table gives no pieces. Texts of any length are cut
    into whole windows as they come. sequence_id is unique across partitions.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), Packer(window)
        sequence = TaskContext.get().partitionId() << 33

        def rows() -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for held in packer.closed:
                offset = 0
                for doc_id, start, ids, total in held:
                    n = len(ids) // 4
                    out.append((doc_id, start, n, zlib.crc32(ids), total, sequence, offset))
                    offset += n
                sequence += 1
            packer.closed.clear()
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc_id, enc.encode(text or "") + end)
            yield rows()
        packer.pour()
        yield rows()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCHEMA)
