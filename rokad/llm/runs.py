"""Periodic runs of words and their removal, by suffix-tree LCE.

Ukkonen's algorithm builds the suffix tree of a word sequence and that of its reversal. An Euler tour of a tree with range minima
answers, in constant time, how far two suffixes agree, so the pair of trees extends any position in both directions. Lyndon roots, for an
order of the words and for its inverse, are the candidates: every run has a root that is the longest Lyndon word at some position
in one of the two. A candidate's extension to both sides is the run of its period.

Runs are short and rare in most texts, so trees are built for windows only. The windows are a lossless choice: in a run of period q
that repeats e times, every sequence of three words but the last q + 2 comes again within q words, and these positions are neighbours.
Stretches of such positions, with what a period can reach beyond them and one word on both sides, hold every run whole.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import cycle, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH = 6
LEAST_REPEATS = 4
#: Words of the sequences that must come again; a run has at least LEAST_LENGTH of them less its period.
GRAM = 3
#: Entries of the Euler tour whose minimum is kept as one value of the table.
BLOCK = 16
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

#: (start, length, period)
Run = tuple[int, int, int]


class SuffixTree:
    """Suffix tree of a list of positive integers; 0, less than all of them, ends it. lce() is vectorised over pairs of positions."""

    def __init__(self, symbols: list[int]) -> None:
        self.s = [*symbols, 0]
        self.sigma = max(self.s) + 1
        self.build()
        self.tour()

    def build(self) -> None:
        """Ukkonen's construction. child is keyed by node * sigma + symbol; a leaf's end is the end of the text."""
        s, sigma, n = self.s, self.sigma, len(self.s)
        start, end, link = [0], [0], [0]
        child: dict[int, int] = {}
        node = edge = length = rest = 0
        for i, c in enumerate(s):
            rest += 1
            last = 0
            while rest:
                if not length:
                    edge = i
                key = node * sigma + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    top = start[below]
                    size = min(end[below], i + 1) - top
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    if s[top + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    middle = len(start)
                    start += (top, i)
                    end += (top + length, n)
                    link += (0, 0)
                    child[key] = middle
                    child[middle * sigma + c] = middle + 1
                    start[below] = top + length
                    child[middle * sigma + s[top + length]] = below
                    if last:
                        link[last] = middle
                    last = middle
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self.start, self.end = start, end
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        #: children of node v, by symbol: children[first[v]: first[v + 1]]
        self.children = np.fromiter(child.values(), np.int64, len(child))[order]
        self.first = np.searchsorted(keys[order], np.arange(len(start) + 1) * sigma)

    def tour(self) -> None:
        """Euler tour: string depth at every visit, the visit of every suffix, and the suffixes in lexicographic order."""
        n, start, end = len(self.s), self.start, self.end
        children, first = self.children.tolist(), self.first.tolist()
        depths, leaves, visit = [0], [], [0] * n
        path, depth_of, turn = [0], [0], [first[0]]
        while path:
            v, at = path[-1], turn[-1]
            if at < first[v + 1]:
                turn[-1] += 1
                w = children[at]
                depth = depth_of[-1] + end[w] - start[w]
                if first[w] == first[w + 1]:
                    suffix = n - depth
                    visit[suffix] = len(depths)
                    leaves.append(suffix)
                    depths += (depth, depth_of[-1])
                else:
                    depths.append(depth)
                    path.append(w)
                    depth_of.append(depth)
                    turn.append(first[w])
            else:
                path.pop()
                depth_of.pop()
                turn.pop()
                if path:
                    depths.append(depth_of[-1])
        self.leaves, self.visit = np.array(leaves), np.array(visit)
        blocks = -(-len(depths) // BLOCK)
        flat = np.full(blocks * BLOCK, n, np.int64)
        flat[: len(depths)] = depths
        grid = flat.reshape(blocks, BLOCK)
        self.depths = flat
        self.to_right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.to_left = np.minimum.accumulate(grid, axis=1).ravel()
        self.table = [grid.min(axis=1)]
        while 2 << (len(self.table) - 1) <= blocks:
            half, low = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(low[:-half], low[half:]))

    def inverse_leaves(self) -> np.ndarray:
        """The suffixes in the order of the inverse alphabet; the end of the text stays the least."""
        n, s, start, end = len(self.s), self.s, self.start, self.end
        children, first = self.children.tolist(), self.first.tolist()
        out, todo = [], [(0, 0)]
        while todo:
            v, depth = todo.pop()
            low, high = first[v], first[v + 1]
            if low == high:
                out.append(n - depth)
                continue
            # the last one pushed comes first: the end of the text, then symbols from the greatest down
            own = children[low:high]
            if s[start[own[0]]] == 0:
                own = [*own[1:], own[0]]
            todo += [(w, depth + end[w] - start[w]) for w in own]
        return np.array(out)

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and at b, different positions each up to the end of the text."""
        x, y = self.visit[a], self.visit[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        left, right = low // BLOCK, high // BLOCK
        out = np.minimum(self.to_right[low], self.to_left[high])
        gap = right - left - 1
        for level, row in enumerate(self.table):
            some = np.flatnonzero((gap >> level) == 1)
            if len(some):
                out[some] = np.minimum(out[some], np.minimum(row[left[some] + 1], row[right[some] - (1 << level)]))
        same = np.flatnonzero(left == right)
        if len(same):
            l, h = low[same], high[same]
            best = self.depths[l]
            for step in range(1, BLOCK):
                best = np.minimum(best, self.depths[np.minimum(l + step, h)])
            out[same] = best
        return out


def lyndon_lengths(leaves: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position, from the order of the suffixes: up to the next smaller suffix."""
    n = len(leaves)
    rank = np.empty(n, np.int64)
    rank[leaves] = np.arange(n)
    ranks, following, out = rank.tolist(), list(range(1, n + 1)), [0] * n
    for i in range(n - 1, -1, -1):
        j, own = i + 1, ranks[i]
        while j < n and ranks[j] > own:
            j = following[j]
        following[i] = j
        out[i] = j - i
    return np.array(out)


def tree_runs(symbols: list[int], least_length: int, least_repeats: int) -> np.ndarray:
    """Rows (start, length, period) of all runs with at least that length and least_repeats (2 or more) times their period."""
    n = len(symbols)
    if n < 2:
        return np.empty((0, 3), np.int64)
    tree = SuffixTree(symbols)
    starts = np.arange(n)
    # the text's end is the least suffix of all, so Lyndon words end there at the latest
    pairs = np.unique(np.concatenate([np.stack([starts, lyndon_lengths(order)[:n]]) for order in (tree.leaves, tree.inverse_leaves())], axis=1), axis=1)
    at, period = pairs[:, pairs[0] + pairs[1] <= n - 1]
    ahead = tree.lce(at, at + period)
    del tree
    # beyond its root and what follows, a run can only gain words before it, less than one period that matters
    back = SuffixTree(symbols[::-1])
    behind = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(at > 0)
    behind[inner] = back.lce(n - at[inner], n - at[inner] - period[inner])
    runs = np.stack([at - behind, behind + period + ahead, period], axis=1)
    return np.unique(runs[runs[:, 1] >= np.maximum(least_length, least_repeats * period)], axis=0)


def windows(hashes: np.ndarray, least_length: int = LEAST_LENGTH, least_repeats: int = LEAST_REPEATS) -> list[tuple[int, int]]:
    """Disjoint ranges that hold every run with one word more on both sides (see the module's text); equal words have equal hashes."""
    n, last = len(hashes), len(hashes) - GRAM + 1
    if n < max(least_length, least_repeats):
        return []
    grams = hashes[:last] * np.int64(0x5851F42D4C957F2D)
    for j in range(1, GRAM):
        grams = (grams + hashes[j: last + j]) * np.int64(0x5851F42D4C957F2D)
    order = np.argsort(grams, kind="stable")
    again = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    if not len(again):
        return []
    at, far = order[again], order[again + 1] - order[again]
    sort = np.argsort(at)
    at, far = at[sort], far[sort]
    while len(at):
        cut = np.flatnonzero(np.diff(at) > 1) + 1
        first, stop = np.r_[0, cut], np.r_[cut, len(at)]
        size = stop - first
        # a run leaves (least_repeats - 1) * q - GRAM + 1 positions at least, so its period is bounded by the stretch it lies in
        most = np.maximum((size + GRAM - 1) // (least_repeats - 1), 0)
        keep = far <= np.repeat(most, size)
        if keep.all():
            break
        at, far = at[keep], far[keep]
    if not len(at):
        return []
    low, high = np.maximum(at[first] - 1, 0), np.minimum(at[stop - 1] + 1 + most + GRAM, n)
    out: list[tuple[int, int]] = []
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_runs(words: list[bytes], least_length: int = LEAST_LENGTH, least_repeats: int = LEAST_REPEATS) -> list[Run]:
    """All runs (start, length, period) of a word sequence, by start, then period."""
    found: list[Run] = []
    n = len(words)
    for low, high in windows(np.fromiter(map(hash, words), np.int64, n), least_length, least_repeats):
        codes: dict[bytes, int] = {}
        part = [codes.setdefault(w, len(codes) + 1) for w in words[low:high]]
        for start, length, period in tree_runs(part, least_length, least_repeats).tolist():
            # at a window's edge inside the text a run may be cut; whole ones lie inside another window, or do not touch this edge
            if (start or not low) and (start + length < high - low or high == n):
                found.append((start + low, length, period))
    return sorted(found)


def with_planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document; where crc32 of its id is divisible by 10, those from a place on repeat with a period, both taken from the crc."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + list(islice(cycle(words[a: a + p]), n - a))


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step)[:-1] == 0).tolist()])


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, compared exactly; ties to the smaller start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _report(doc_id: int | None, words: list[bytes]) -> tuple:
    runs = find_runs(words)
    start, length, period = strongest(runs) or (None, None, None)
    lines = "".join(f"{s},{l},{q}\n" for s, l, q in runs)
    return (doc_id, len(runs), start, length, period, 1000 * length // period if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(words, runs)).hexdigest())


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def document_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period, words: every run of every text as it is, one row each; words is the repeated part as text.

    Null and empty texts have no run. Repeated rows give their runs once each. Other columns are ignored.
    """
    schema = "doc_id long, start long, length long, period long, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()
                rows += [(doc_id, s, l, q, b" ".join(words[s: s + q])) for s, l, q in find_runs(words)]
            yield _columns(rows, schema)

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)
    return found.withColumn("words", F.decode("words", "utf-8"))


def collapse_runs(docs: DataFrame) -> DataFrame:
    """docs with every run in text cut to its first period, words joined by one space; texts without a run stay as they are, null too."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                words = (text or "").encode().split()
                runs = find_runs(words)
                texts.append(collapse(words, runs).decode() if runs else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))

    return docs.mapInArrow(run, schema)


def run_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: number of runs, the strongest one, and digests of all runs and of the words kept.

    Documents whose id's crc32 is divisible by 10 get a planted run first (with_planted_run); rows without id do not. Null and empty texts
    have no word: n_runs 0, nulls, digests of nothing. Repeated rows give one row each; other columns are ignored; an empty table gives an
    empty result. A text is one row, read whole; the trees of its longest window are what a task holds besides the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _columns([_report(doc_id, with_planted_run(doc_id, (text.as_py() or b"").split()))
                            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)], SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, SCHEMA)
