import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def given(spark, sf):
    """The given documents as Python rows (doc_id, text, lang, source)."""
    return [tuple(r)[:4] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = "word " * 60_000 + "\n" + "x" * 30_000
    return [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here at all", "en", "a", 17), (3, " \t\n ", None, "b", 4),
            (4, long, "en", None, len(long)), (5, "the same text twice", "en", "a", 19), (5, "the same text twice", "en", "a", 19),
            (6, "the same text twice", "de", "b", 19), (7, "één ünïcode 漢字 text\nwith lines", "fr", "b", 30)]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture
def clashing(spark, odd_rows):
    """The same rows with columns whose names the operators use themselves."""
    extra = "n long, key string, cls string, size int, score string, rank int, kind string, mark string, batch int, u double, `a.b` int"
    return spark.createDataFrame([(*r, 1, "k", "c", 2, "s", 3, "x", "m", 4, 0.5, 6) for r in odd_rows], f"{DOCS}, {extra}")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)
