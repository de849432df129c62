"""Steps that were made smaller or brought in line with their SQL."""
from datetime import date
from decimal import Decimal as D

from rokad.operators import matching as mt
from rokad.operators import staging
from rokad.sources import statements as st
from rokad.sources.returns import Tables


def test_staged_rows_are_columns(spark):
    assert "parquet" in staging.stage(spark.range(3)).inputFiles()[0]


def test_tolerance_pairs_are_cut_per_line(spark):
    docs = [(1, "in", f"V{i:02}", 1000000 + i, date(2026, 1, 10), None, None) for i in range(30)]
    d = spark.createDataFrame(docs, "client_id int, dir string, voucher_id string, due long, document_date date, d_ref string, d_party string")
    ln = spark.createDataFrame([(1, "in", "L1", 999000, date(2026, 1, 11), None, None)],
                               "client_id int, dir string, line_id string, amt long, txn_date date, l_ref string, l_party string")
    assert sorted(r["voucher_id"] for r in mt.candidates(ln, d).collect()) == ["V00", "V01", "V02", "V03"]


def test_party_pieces_only_of_lengths_that_occur(spark):
    lines = spark.createDataFrame([(1, "Customer#000000001"), (2, "xx ACME yy")], "client_id int, counterparty string")
    names = spark.createDataFrame([(1, "C7", "Customer#000000001"), (1, "C3", "customer#000000001"), (2, "A", "Acme"), (1, "B", "Acme")],
                                  "client_id int, party_id string, party_name string")
    assert {tuple(r) for r in mt.resolve_party(lines, names).collect()} == {(1, "Customer#000000001", "C3"), (2, "xx ACME yy", "A")}


def test_printed_zero_is_a_row_when_asked(spark):
    grid = spark.createDataFrame([("f", 2, ["01/02/2024", "a", "0.00", "5.00"]), ("f", 3, ["01/02/2024", "b", "", "5.00"])], "file_id string, line_no long, cells array<string>")
    heads = spark.createDataFrame([("f", 1, "dd/MM/yyyy", 0, None, 1, None, None, None, 2, None, 3)], "file_id string, header_line long, fmt string, " + ", ".join(
        f"c_{r} int" for r in st.ROLES))
    kept = {r["line_no"]: (r["reason"], r["credit"]) for r in st.build_rows(grid, heads, printed_zero=True).collect()}
    assert kept == {2: (None, D("0.00")), 3: ("zero amount on both sides", D("0.00"))}
    assert {r["reason"] for r in st.build_rows(grid, heads).collect()} == {"zero amount on both sides"}


def test_the_score_of_a_party_is_a_number(spark):
    pair = spark.createDataFrame([(100, date(2026, 1, 1), None, "P1", 100, date(2026, 1, 3), None, "P1"), (100, date(2026, 1, 1), None, "P1", 900000, date(2025, 1, 1), None, "P1")],
                                 "amt long, txn_date date, l_ref string, l_party string, due long, document_date date, d_ref string, d_party string")
    assert [r[0] for r in pair.select(mt._score()).collect()] == [50, 15]


def test_the_matcher_reads_documents_staged_once(spark):
    plain, held = Tables(spark, "/root/testdata/sf0.001"), Tables(spark, "/root/testdata/sf0.001")
    held.hold_documents()
    for name in ("bank_lines", "receipts", "payments"):
        assert not [f for f in getattr(held, name).inputFiles() if "lineitem" in f]
        assert getattr(held, name).exceptAll(getattr(plain, name)).isEmpty() and getattr(plain, name).exceptAll(getattr(held, name)).isEmpty()
