"""Token files, periodic runs and hard negatives against plain versions, and on odd inputs."""
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("rokad.llm")

from rokad.llm import ann, hardneg, jobs, neardup, runs, tokenfile, tokens  # noqa: E402
from rokad.llm.common import new_folder, small_batches, table  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.tokenizer_path(tokens.WORD_BPE))


# ------------------------------------------------------------------ token files

def plain_tokens(library, rows, end_id=1):
    out, at = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_given(spark, sf, given, library):
    got = sorted(tuple(r) for r in jobs.QUERIES["op11_token_files"](spark, sf).collect())
    assert got == plain_tokens(library, [r[:2] for r in given])


def test_encode_batch_is_the_library(library):
    odd = [None, "", " ", "a\x01b <|endoftext|> x<|startoftext|>y", "İSTANBUL ǅ ﬁ 漢字 x y", "  lead", "trail \n", "don't I'LL 12a3's", "ß ẞ É́", "x" * 5000]
    ids, sizes = tokens.encoder().encode_batch(pa.array(odd))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in odd]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert [len(x) for x in tokens.encoder().encode_batch(pa.array([], pa.string()))] == [0, 0]


def test_token_files_odd(odd, clashing, nothing, odd_rows, library):
    """Rows without id are first; rows that repeat an id are next to each other."""
    for df in (odd, clashing):
        got = sorted((tuple(r) for r in tokenfile.token_report(df).collect()), key=lambda r: r[1])
        assert [r[0] for r in got] == sorted([r[0] for r in odd_rows], key=lambda x: (x is not None, x or 0))
        text = {r[0]: r[1] for r in odd_rows}
        assert got == plain_tokens(library, [(r[0], text[r[0]]) for r in got])
    assert tokenfile.token_report(nothing).count() == 0


def test_token_files_are_in_order_and_pruned(spark, sf):
    path = new_folder(spark, "tokens-test")
    docs = table(spark, sf, "documents")
    tokenfile.write_tokens(docs, path)
    rows = tokenfile.read_tokens(spark, path).orderBy("part", "at").collect()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids) and all(len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == tokenfile.END_ID for r in rows)

    def read(condition):
        df = tokenfile.read_tokens(spark, path, condition)
        found = df._jdf.queryExecution()
        n = found.executedPlan().executeCollectPublic()
        leaf = found.executedPlan().collectLeaves().head()
        return len(n), leaf.metrics().apply("numOutputRows").value(), str(found.executedPlan())

    import pyspark.sql.functions as F
    n, scanned, plan = read(F.col("doc_id") == max(ids) + 1)
    assert n == 0 and scanned == 0 and "PushedFilters" in plan
    assert read(F.col("doc_id") == ids[3])[0] == 1


def test_token_files_hot_id(spark, library):
    """Rows of one id, a third of all, and equal ones lie next to each other, and every id counts once."""
    rows = [(i if i % 3 else 7, f"text number {i % 20}") for i in range(300)]
    got = sorted((tuple(r) for r in tokenfile.token_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(d for d, _ in rows)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((d, n, c) for d, _, n, c in plain_tokens(library, rows))


def test_small_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (1, 9, 30, 2, 2)]), pa.array(range(5))], names=["t", "i"])
    parts = list(small_batches([batch], 0, most=10))
    assert [b.column(1).to_pylist() for b in parts] == [[0, 1], [2], [3, 4]]
    assert list(small_batches([batch.slice(0, 0)], 0)) == []


# ------------------------------------------------------------------ periodic runs

def plain_runs(words, least_length=6, least_repeats=4):
    """Stretches in which words q apart are equal, for every q; one that a smaller period has too is dropped."""
    n, out = len(words), {}
    for q in range(1, n // least_repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least_length, least_repeats * q):
                out.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_report(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, l, q in found for i in range(s + q, s + l)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), math.floor(1000 * best[1] / best[2]) if best else None,
            sha("".join(f"{s},{l},{q}\n" for s, l, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def some_words(rng, longest):
    n, k = rng.randint(0, longest), rng.randint(1, 4)
    words = [b"%d" % rng.randint(0, k) for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, 6)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_runs_on_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        words = some_words(rng, 60)
        assert runs.find_runs(words) == plain_runs(words)
        codes = {}
        part = [codes.setdefault(w, len(codes) + 1) for w in words]
        for limits in ((6, 4), (2, 2)):  # trees over the whole sequence, without windows
            assert [tuple(r) for r in runs.tree_runs(part, *limits).tolist()] == plain_runs(words, *limits)


def test_suffix_tree_lce():
    rng = random.Random(8)
    for _ in range(60):
        s = [rng.randint(1, 3) for _ in range(rng.randint(2, 120))]
        tree = runs.SuffixTree(s)
        assert tree.leaves.tolist() == sorted(range(len(s) + 1), key=lambda i: s[i:])
        a, b = np.array([(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]).T
        want = [next((k for k in range(len(s)) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]), 0) for i, j in zip(a, b, strict=True)]
        assert tree.lce(a, b).tolist() == want


def test_windows_hold_runs_in_long_texts():
    """Periods from 1 to a hundred inside texts without repetition, with sequences that recur far apart."""
    rng = random.Random(2)
    for p in (1, 2, 3, 17, 100):
        before, unit, after = ([b"%x" % rng.getrandbits(40) for _ in range(rng.randint(0, 300))] for _ in range(3))
        unit = [b"u%d" % i for i in range(p)]
        passage = [b"p%d" % i for i in range(30)]
        words = passage + before + unit * 6 + unit[: p // 2] + after + passage
        assert runs.find_runs(words) == plain_runs(words) and len(plain_runs(words)) == 1


def test_run_report_given(spark, sf, given):
    got = sorted(tuple(r) for r in jobs.QUERIES["op12_periodic_runs"](spark, sf).collect())
    assert got == [plain_report(*r[:2]) for r in given]
    assert sum(r[1] > 0 for r in got) > 10


def test_run_report_odd(odd, clashing, nothing, odd_rows):
    rows = [r for r in odd_rows if not r[1] or len(r[1]) < 10_000]
    for df in (odd, clashing):
        got = {tuple(r) for r in runs.run_report(df).collect()}
        assert got >= {plain_report(*r[:2]) for r in rows}
        long = next(r for r in got if r[0] == 4)
        assert long[1:6] == (1, 0, 60_000, 1, 60_000_000)
        assert runs.run_report(df).count() == len(odd_rows)
    assert runs.run_report(nothing).count() == 0


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c"), (2, None), (3, "no run  here"), (None, "x x x x x x x")], "doc_id long, text string")
    assert [tuple(r) for r in runs.document_runs(docs).orderBy("doc_id").collect()] == [(None, 0, 7, 1, "x"), (1, 0, 8, 2, "a b")]
    assert {tuple(r) for r in runs.collapse_runs(docs).collect()} == {(1, "a b c"), (2, None), (3, "no run  here"), (None, "x")}


# ------------------------------------------------------------------ hard negatives

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_negatives(rows, k=5):
    own = []
    for vec_id, v, label in rows:
        if vec_id is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((vec_id, [math.floor(256 * x) for x in v], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for a, v, label in own:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), c, other == label) for c, w, other in own if c != a and len(w) == len(v))
        for below, positive, _ in [s for s in scored if s[2]][:k]:
            fit = [(n, c) for n, c, same in scored if not same and 80 * -below <= 100 * -n <= 100 * -below][:k]
            out += [(a, positive, i, c, -below, -n) for i, (n, c) in enumerate(fit, 1)]
    return sorted(out)


def negatives(spark, rows, block=hardneg.BLOCK):
    df = spark.createDataFrame(rows, VECTORS)
    return sorted(tuple(r) for r in hardneg.mine(df, df.filter("vec_id % 100 = 0"), block=block).collect())


def test_hard_negatives_given(spark, sf):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table(spark, sf, "embeddings").collect()]
    got = sorted(tuple(r) for r in jobs.QUERIES["op13_hard_negatives"](spark, sf).collect())
    assert got == plain_negatives(rows) and len(got) > 50


def test_hard_negatives_ties_and_tiles(spark, monkeypatch):
    """Coarse vectors make many ties; one label holds most rows; small blocks and parts cut anchors' rows into many tiles."""
    monkeypatch.setattr(hardneg, "COLUMNS", 37)
    monkeypatch.setattr(hardneg, "ROWS", 2)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) / 4 for x in rng.integers(-1, 3, 5)], int(rng.choice([1, 1, 1, 2, 3, 9]))) for i in range(900)]
    want = plain_negatives(rows)
    assert len(want) > 100 and negatives(spark, rows, block=128) == want == negatives(spark, rows)


def test_hard_negatives_odd(spark):
    near = [(i, [1.0, i / 100], i % 3) for i in range(1, 30)]
    odd = [(100, [1.0, 0.5], 1), (200, [math.nan, 1.0], 1), (300, None, 1), (400, [1.0, None], 2), (500, [1.0, 1.0], None), (600, [math.inf, 1.0], 1),
           (700, [], 1), (800, [], 1), (801, [], 2), (None, [1.0, 1.0], 1), (900, [-1.0, -1.0], 5), (1000, [0.0, 0.0], 1), (1100, [1.0], 1)]
    rows = near + odd
    assert negatives(spark, rows) == plain_negatives(rows)
    # scores beyond what a long holds: such rows take no part
    assert negatives(spark, [*rows, (31, [1e300, 1.0], 2), (32, [1e9, 1e9], 2)]) == plain_negatives(rows)
    assert negatives(spark, []) == []
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"{VECTORS}, id long, kind string, block int")
    assert sorted(tuple(r) for r in hardneg.mine(df, df.filter("vec_id % 100 = 0")).collect()) == plain_negatives(rows)
    # rows that repeat an id: candidates each, the least one as anchor
    twice = [(100, [1.0, 0.0], 1), (100, [0.5, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (2, [0.9, 0.0], 2)]
    assert negatives(spark, twice) == [(100, 1, 1, 2, 128 * 256, 128 * 230), (100, 1, 2, 2, 128 * 256, 128 * 230)]


def test_scores_are_exact():
    rng = np.random.default_rng(9)
    a, b = (rng.integers(-(1 << 25), 1 << 25, (6, 8)).astype(float) for _ in range(2))
    assert hardneg.scores(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b] for r in a]


# ------------------------------------------------------------------ near duplicates of repeated ids

def test_near_duplicates_of_one_id(spark):
    """Two texts of one id join their groups, so that the least document of all of them is the one to stay."""
    x, y = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(3, x), (5, x), (5, y), (7, y + " c")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False)]


# ------------------------------------------------------------------ nearest neighbours at the ends of the doubles

@pytest.mark.parametrize("size", [1e200, 1.0, 1e-200])
def test_nearest_of_very_large_and_small_components(spark, size):
    """No candidate is lost where squares would leave the range of doubles."""
    rows = [(i, [size * (1 + i % 7), size * (i % 3)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r)[:3] for r in ann.nearest(df, df.filter("vec_id < 3"), k=4).orderBy("query_id", "rank").collect()]
    want = []
    for q, v in rows[:3]:
        far = sorted((math.hypot((v[0] - w[0]) / size, (v[1] - w[1]) / size), c) for c, w in rows if c != q)
        want += [(q, i, c) for i, (_, c) in enumerate(far[:4], 1)]
    assert got == want
