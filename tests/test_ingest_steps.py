"""Statement ingestion whose cost per row stays small, with the same results on odd input."""
from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from rokad.functions import text
from rokad.functions.dates import parse_date
from rokad.operators.prefix import running_sum_by_size
from rokad.sources import statements as st
from rokad.sources.returns import Tables

HEADS = "file_id string, header_line long, fmt string, " + ", ".join(f"c_{r} int" for r in st.ROLES)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _lines(spark, files: dict[str, list[str]]):
    return spark.createDataFrame([(f, i, x) for f, lines in files.items() for i, x in enumerate(lines, 1)], "file_id string, line_no long, line string")


def _ingest(spark, lines):
    recs = st.records(lines)
    grid = st.cells(recs, st.delimiters(recs))
    heads = st.headers(grid)
    return grid, heads, st.build_rows(grid, heads)


def test_running_sum_of_small_and_hot_keys(spark):
    rows = [(k, i // 3, i, i + k) for k, n in ((1, 7), (2, 40)) for i in range(n)] + [(3, 0, 0, None)]
    df = spark.createDataFrame(rows, "k int, d int, i int, v int")
    want = {(k, i): sum(v or 0 for k2, _, j, v in rows if k2 == k and j <= i) for k, _, i, _ in rows}
    for hot in (0, 10, 1000):
        got = running_sum_by_size(df, ["k"], ["d"], ["d", "i"], {"s": F.col("v")}, "long", hot)
        assert {(r["k"], r["i"]): r["s"] for r in got.collect()} == want


def test_stated_lines_are_made_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.stated_lines.inputFiles() and not [f for f in t.statements.inputFiles() if "testdata" in f]


def test_rows_and_votes_are_compiled(spark):
    grid = spark.createDataFrame([("f", 2, ["01/02/2024"])], "file_id string, line_no long, cells array<string>")
    heads = spark.createDataFrame([], HEADS)
    assert "lambda" not in _plan(st.build_rows(grid, heads).drop("text"))
    assert "lambda" not in _plan(st.delimiters(_lines(spark, {"f": ["a,b"]})))


def test_delimiter_votes_equal_cells_made(spark):
    rows = ['a,b;c', '"x,y";z;"p;q', 'no delimiter', '"a""b,c",d', '"open,to the end', '', 'a\x01b|c']
    df = spark.createDataFrame([(r,) for r in rows], "line string")
    for d, n in zip(st.DELIMITERS, st._widths(F.col("line"))):
        assert [r["a"] for r in df.select(n.alias("a")).collect()] == [r["a"] for r in df.select(F.size(st.split_cells(F.col("line"), d)).alias("a")).collect()]
    recs = _lines(spark, {"f": ["one", "two"], "g": ["a;b", "c;d"], "h": ["x"]})
    assert {tuple(r) for r in st.delimiters(recs).collect()} == {("f", 0), ("g", 2), ("h", 0)}


def test_odd_amounts_and_dates(spark):
    amounts = {"1,234.50 Dr": ("1234.50", True), "(12.345)": ("12.35", True), "+7": ("7.00", False), "NIL": ("0.00", False), "Rs 5": (None, False), "(8) cr": (None, False),
               "₹ 2.0049999": ("2.00", False), "": ("0.00", False), "1.2.3": (None, False), "-9.5CR.": ("9.50", True)}
    got = spark.createDataFrame([(x,) for x in amounts], "x string").select("x", text.parse_amount(F.col("x")).alias("p")).collect()
    assert {r["x"]: (r["p"]["value"], r["p"]["negative"]) for r in got} == {k: (v and D(v), n) for k, (v, n) in amounts.items()}
    days = {"29/02/2024": date(2024, 2, 29), "29/02/2023": None, "5 Sept 71 10:15": date(1971, 9, 5), "1-dec-24": date(2024, 12, 1), "1-foo-24": None, "": None, "Total": None, "0/1/24": None}
    got = spark.createDataFrame([(x,) for x in days], "x string").select("x", parse_date(F.col("x"), F.lit("dd/MM/yyyy")).alias("d")).collect()
    assert {r["x"]: r["d"] for r in got} == days


FILES = {
    "a": ["Statement for the period 01/01/2024 to 31/01/2024", "Txn  Date,Narration,Debit,Credit,Balance", "Opening Balance,,,,900.00", "02/01/2024,first,,100.00,\"1,000.00\"",
          "03/01/2024,\"broken", "line\",40.00,,960.00", "Closing Balance,,,,950.00"],
    "b": ["Date,Description,Amount,Balance", "05/01/2024,Opening Balance,,500.00", "06/01/2024,x,-20.00,480.00", "07/01/2024,y,5.00,"],
    "c": ["no heading", "01/01/2024,1.00"],
}


def test_balances_and_periods_of_odd_files(spark):
    grid, heads, rows = _ingest(spark, _lines(spark, FILES))
    bals = st.balances(grid, rows, heads)
    assert {(r["file_id"], r["opening_balance"], r["closing_balance"]) for r in bals.collect()} == {("a", D("900.00"), D("950.00")), ("b", D("500.00"), None)}
    periods = st.periods(grid, heads, bals)
    assert {tuple(r) for r in periods.collect()} == {("a", date(2024, 1, 1), date(2024, 1, 31)), ("b", date(2024, 1, 6), date(2024, 1, 7))}


def test_period_dates_are_parsed_as_columns(spark):
    grid, heads, rows = _ingest(spark, _lines(spark, FILES))
    assert "lambda" not in _plan(st.periods(grid, heads, spark.createDataFrame([], "file_id string, first_date date, last_date date")))


def test_balances_beside_and_beneath_their_labels(spark):
    table = ["Date,Narration,Debit,Credit,Balance", "02/01/2024,first,,100.00,"]
    files = {
        # a summary at the foot: headings, and values in their columns below
        "foot": [*table, "Statement summary", "Opening Balance,Dr Count,Cr Count,Debits,Credits,Closing Bal", ",,,,,", "7.00,0,1,0.00,100.00,107.00"],
        # one at the head, values in the next row
        "head": ["Opening Balance,Count,Closing Balance", "8.00,1,108.00", *table],
        # too far below
        "far": [*table, "x,Opening Balance", "a,b", "c,d", "e,9.00"],
        # the nearest number to the left, a whole number behind the label, a date behind it that is none
        "left": ["5.00,6.00,Opening Balance", *table, "Closing Balance: 106"],
        "date": ["Opening Balance as on 01/01/2024:,11.00", *table, "12.00 Closing Balance,13.00"],
    }
    grid, heads, rows = _ingest(spark, _lines(spark, files))
    got = {r["file_id"]: (r["opening_balance"], r["closing_balance"]) for r in st.balances(grid, rows, heads).collect()}
    assert got == {"foot": (D("7.00"), D("107.00")), "head": (D("8.00"), D("108.00")), "far": (None, None), "left": (D("6.00"), D("106.00")), "date": (D("11.00"), D("13.00"))}
