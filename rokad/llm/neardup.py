"""Near duplicates by bottom-k sketches of one hash function.

1. Every text becomes a set of shingle hashes; equal sets are one class, and a class goes on as its least document.
2. A class's sketch is the k least hashes of its set. Inverted lists of the first KEPT of them give, per pair of classes, how many both retain.
   Values in at most LIST classes are cold, the others hot. Lists of cold values give their pairs; a pair goes on with
   two common ones (with one, where a set is smaller than its sketch).
3. A set with a similarity of 0.8 to another loses at most a fifth of the union. So a pair without common cold values has few of them, and
   both classes have a cold share under COLD. Such hot classes are listed again under pairs of their hot values that stand next to each
   other or one apart; as most hot values of such a pair are common, two of these stand so in both. Long lists are stars first: every
   member with the least one. After the components of the links found are known, members of a list that are outside its largest
   component meet all members of other components. Pairs within a component need no check.
   They do so in blocks that a task compares at once, and only pairs that may be similar come out.
4. The union-sketch estimate of a pair (from a longer sketch, SKETCH) decides whether it goes on; its link is then decided on the full sets. Components of all links give the
   result.

The chance that a pair of large sets at exactly 0.8 is missed is under 1e-4, with edits on both sides or text that only one has, where what differs
is spread like the rest; sets smaller than their sketch are never missed. No list is capped, no pair within a group is made beyond what step 3 needs, and only pairs' full sets move.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import choose_by_id, components, forget, shingles, small_batches, stage

SKETCH = 128
KEPT = 32
LIST = 32
#: Cold share from which a class is no member of a large family: 18 of 32. Text that only one side has, a fifth of its set at 0.8, gives so many with a chance of 7e-6.
COLD = 0.55
#: Hot values that are listed in pairs: the first ones of a set.
HOT = 12
#: Least overlap, of SKETCH, in the sketch of the union: a similarity of 0.8 falls below with a chance under 1e-4.
OVERLAP = 84
#: Rows of a block of a long list.
BLOCK = 1024
#: Values compared at once.
COLUMNS = 2048
SHINGLE = 5
PERCENT = 80


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def shingle_sets(docs: DataFrame, size: int, k: int = SKETCH) -> DataFrame:
    """doc_id, n (set size), cls (hash of the set; empty set: null), sketch (k least hashes, as sorted unsigned values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in small_batches(batches, 1):
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([_signed(s[:k]) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "cls", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, cls binary, sketch array<long>")


def _list_pairs(lists: DataFrame, percent: int, k: int) -> DataFrame:
    """a, b, need: pairs of members of each list (array of id, n) whose sizes allow the similarity; need: lists they must meet in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten()
            bounds = batch.column(0).offsets.to_numpy() - batch.column(0).offsets[0].as_py()
            ids, n = (flat.field(i).to_numpy() for i in range(2))
            left, right = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                i, j = np.triu_indices(hi - lo, 1)
                left.append(i + lo)
                right.append(j + lo)
            i, j = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (left, right))
            fit = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (ids[i] != ids[j])
            i, j = i[fit], j[fit]
            need = np.where(np.minimum(n[i], n[j]) < k, 1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(need)], names=["a", "b", "need"])

    return lists.mapInArrow(run, "a long, b long, need long")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sketches (sorted, unsigned) leave the similarity possible: OVERLAP in the union's sketch, or the exact rule for whole sets."""
    union = np.union1d(x, y)[:SKETCH]
    both = np.intersect1d(x, y, assume_unique=True)
    shared = int(np.searchsorted(both, union[-1], "right"))
    return 100 * shared >= percent * len(union) if len(union) < SKETCH else shared >= OVERLAP


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches leave the similarity possible."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sketches = [[np.array(s, np.int64).view(np.uint64) for s in batch.column(c).to_pylist()] for c in (2, 3)]
            keep = [_alike(x, y, percent) for x, y in zip(*sketches, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _full_sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """id, full: the whole shingle set of each document among ids, sorted, as bytes."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, size).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "full"])

    return choose_by_id(docs.select(F.col("doc_id").cast("long"), "text"), stage(ids), "doc_id", then=full, schema="id long, full binary").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on their full sets."""
    sets = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in small_batches(batches, 2, 3):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("id").alias(x), F.col("full").alias(f"f{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long").distinct()


def _between(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: links between members of a list outside its main component and members of other components.

    members has key, rep, n, comp, main, and the numbers of blocks into which both sides are cut (xs, ys), of about BLOCK rows each. A task compares
    two blocks by one product of their full sets' membership matrices, some COLUMNS of values at a time, so only links come out.
    """
    sets = stage(_full_sets(members.select(F.col("rep").alias("id")).distinct(), docs, size))
    full = lambda: sets.select(F.col("id").alias("rep"), F.col("full").alias("full"))
    block = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    names = ["key", "x", "y", "rep", "n", "comp"]
    x_side = members.filter("comp <> main").withColumn("x", block(1, "xs")).withColumn("y", every("ys")).select(names).join(full(), "rep")
    y_side = members.withColumn("y", block(2, "ys")).withColumn("x", every("xs")).select(*[F.col(c).alias(c) for c in names]).join(full(), "rep")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        forget()
        if not len(x) or not len(y):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

        def flat(side: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sets = [np.frombuffer(f, np.uint64) for f in side.full]
            lengths = np.array([len(s) for s in sets], np.int64)
            return np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths), lengths

        (vx, rx, nx), (vy, ry, ny) = flat(x), flat(y)
        common = np.intersect1d(vx, vy)

        def places(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(common, values)
            hit = (at < len(common)) & (common[np.minimum(at, max(0, len(common) - 1))] == values) if len(common) else np.zeros(len(values), bool)
            order = np.argsort(at[hit], kind="stable")
            return at[hit][order], rows[hit][order]

        (ax, rx), (ay, ry) = places(vx, rx), places(vy, ry)
        shared = np.zeros((len(nx), len(ny)), np.float32)
        for start in range(0, len(common), COLUMNS):
            parts = []
            for at, rows, n in ((ax, rx, len(nx)), (ay, ry, len(ny))):
                own = slice(*np.searchsorted(at, (start, start + COLUMNS)))
                m = np.zeros((n, min(COLUMNS, len(common) - start)), np.float32)
                m[rows[own], at[own] - start] = 1
                parts.append(m)
            shared += parts[0] @ parts[1].T
        fit = (100 * shared >= percent * (nx[:, None] + ny - shared)) & (x.comp.to_numpy()[:, None] != y.comp.to_numpy())
        i, j = np.nonzero(fit)
        a, b = x.rep.to_numpy()[i], y.rep.to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    key = ["key", "x", "y"]
    return x_side.groupBy(*key).cogroup(y_side.groupBy(*key)).applyInPandas(run, "a long, b long").distinct()


def near_links(docs: DataFrame, classes: DataFrame, size: int, percent: int = PERCENT, k: int = KEPT, list_size: int = LIST) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) between classes, and their components (node, component)."""
    member = F.struct("rep", "n")
    retained = classes.select("rep", "n", F.least(F.size("sketch"), F.lit(k)).alias("kept"), F.explode(F.slice("sketch", 1, k)).alias("v"))
    often = stage(retained.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1"))
    met = stage(retained.join(often, "v"))
    pairs = _list_pairs(met.filter(F.col("c") <= list_size).groupBy("v").agg(F.collect_list(member).alias("m")).select("m"), percent, k)
    hot = met.filter(F.col("c") > list_size).groupBy("rep", "n", "kept").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    hot = stage(hot.filter(F.col("kept") - F.size("vs") < COLD * F.col("kept")).withColumn("vs", F.slice("vs", 1, HOT)))
    left = lambda gap: F.greatest(F.size("vs") - gap, F.lit(0))
    following = [F.zip_with(F.slice("vs", 1, left(gap)), F.slice("vs", F.lit(1 + gap), left(gap)), lambda x, y: F.xxhash64(x, y)) for gap in (1, 2)]
    keyed = hot.select("rep", "n", F.explode(F.array_distinct(F.concat(*following))).alias("key"))
    sizes = stage(keyed.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("rep", "n")).alias("hub")).filter("c > 1"))
    listed = stage(keyed.join(sizes, "key"))
    again = _list_pairs(listed.filter(F.col("c") <= list_size).groupBy("key").agg(F.collect_list(member).alias("m")).select("m"), percent, k)
    long = listed.filter(F.col("c") > list_size)
    alike = (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")) & (F.col("rep") != F.col("hub.rep"))
    stars = long.filter(alike).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"))

    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("need").alias("need")).filter("c >= need").select("a", "b")
    first = counted.unionByName(again.select("a", "b")).unionByName(stars).distinct()
    links = stage(_confirmed(stage(_estimated(first, classes, percent)), docs, size, percent))
    found = components(links)

    # members of long lists that the stars left outside the list's largest component
    placed = long.select("key", "rep", "n").join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    placed = stage(placed)
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    split = parts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    split = split.select("key", F.col("m.comp").alias("main"), F.ceil((F.col("all") - F.col("m.c")) / BLOCK).alias("xs"), F.ceil(F.col("all") / BLOCK).alias("ys"))
    members = stage(placed.join(split, "key"))
    if members.isEmpty():
        return links, found
    more = stage(_between(members, docs, size, percent))
    links = links.unionByName(more).distinct()
    return links, components(links)


def _one_id(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: representatives of the classes that rows with one id belong to, each with the least of them."""
    several = stage(sets.groupBy("doc_id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x <> y").select("doc_id"))
    held = sets.join(several, "doc_id", "left_semi").select("doc_id", "cls").distinct().join(classes.select("cls", "rep"), "cls").select("doc_id", "rep")
    least = held.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return stage(held.join(least, "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct())


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words lie between ASCII white space, A-Z lower-cased; a set is the text's distinct `size`-word shingles, or the whole sequence where words
    are fewer. Texts that are null or have no word are empty sets, linked with nothing. Rows that repeat an id are one document: a link of one
    is a link of all. Rows without id are linked with nothing: no component, kept. Other columns are ignored; empty tables stay empty.
    """
    base = stage(shingle_sets(docs, size))
    usable = base.filter("cls is not null and doc_id is not null")
    classes = usable.groupBy("cls").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("m"), F.count("*").alias("members"))
    classes = stage(classes.select("cls", F.col("m.doc_id").alias("rep"), F.col("m.n").alias("n"), F.col("m.sketch").alias("sketch"), "members"))
    links, found = near_links(docs, classes.select("rep", "n", "sketch"), size, percent)
    same = _one_id(usable, classes)
    if not same.isEmpty():
        found = components(links.unionByName(same))
    placed = classes.join(found, F.col("rep") == F.col("node"), "left").select("cls", "members", "rep", F.coalesce("component", "rep").alias("comp"))
    moved = stage(placed.filter("members > 1 or comp <> rep").select("cls", "comp"))
    joined = base.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(moved, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
