"""Work that must not grow faster than the input."""
from pyspark.sql import functions as F

from rokad.functions import gstin
from rokad.operators.pairing import rank_pairs
from rokad.plans import books as k
from rokad.sources.returns import Tables


def _plain_digit(first14: str) -> str:
    total = 0
    for i, ch in enumerate(first14):
        quotient, rest = divmod(gstin.ALPHABET.index(ch) * (1 + i % 2), 36)
        total += quotient + rest
    return gstin.ALPHABET[-total % 36]


def test_party_rules_do_not_copy_the_number_into_filters(spark):
    first = F.concat(F.lit("07AAACN"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("N1Z"))
    parties = spark.range(200).select(
        F.col("id").cast("string").alias("party_id"), F.lit("registered_regular").alias("gst_category"), F.lit("07").alias("state_code"),
        F.when(F.col("id") != 3, gstin.with_check_digit(first)).alias("gstin"))
    assert all(r["gstin"][14] == _plain_digit(r["gstin"][:14]) for r in parties.filter("gstin IS NOT NULL").collect())
    found = k.validate_parties(parties)
    assert [tuple(r) for r in found.collect()] == [("DIM-GSTIN", "3")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the text of a number is made where it is stored; the rules' filters do not make it again
    assert not [line for line in plan.splitlines() if "Filter" in line and "lpad" in line]


def test_doubled_places_match_plain_sums(spark):
    texts = ["0A1B2C3D4E5F6G", "ZYXWVUTSRQPONM", "99999999999999", "ABCDEFGHIJKLMN"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", gstin.check_digit(F.col("x")).alias("d")).collect()
    assert {r["x"]: r["d"] for r in got} == {x: _plain_digit(x) for x in texts}


def test_rank_pairs_shuffles_both_sides_once(spark):
    left = spark.createDataFrame([("a", 2, "L2"), ("a", 1, "L1"), ("a", 3, "L3"), ("b", 1, "L4"), (None, 1, "L5")], "k string, day int, id string")
    right = spark.createDataFrame([("a", 9, "R2"), ("a", 8, "R1"), ("c", 1, "R3"), (None, 1, "R4")], "k string, day int, id string")
    pairs = rank_pairs(left, right, ["k"], ["day"])
    assert {tuple(r) for r in pairs.collect()} == {("L1", "R1"), ("L2", "R2")}
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rank_pairs(left, right, ["k"], ["day"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert plan.count("Exchange hashpartitioning") == 1


def test_statement_is_made_from_bills_staged_once(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    for side in (tables.gstr_2b, tables.manual_pairs):
        files = side.inputFiles()
        assert files and not [f for f in files if f.startswith("file:///root/testdata")]


def test_dimension_rules_beside_the_parties(spark):
    schema = "party_id string, nation int, gst_category string, state_code string, gstin string"
    number = "07AAACN0001N1Z"
    full = number + _plain_digit(number)
    parties = spark.createDataFrame([("C1", 1, "registered_regular", "07", full), ("C2", 1, "registered_regular", "07", full), ("C3", 2, "registered_regular", "07", full),
                                     ("C4", 2, "unregistered", "07", "07AAACN0002N1Z" + _plain_digit("07AAACN0002N1Z"))], schema)
    clients = spark.createDataFrame([(5, 1, "08", full), (6, 1, "07", None)], "client_id int, firm_id int, state_code string, gstin string")
    chart = spark.createDataFrame([(5300, "expense", None, None), (4300, "income", "opex", "current"), (1300, "asset", None, None), (1301, "asset", None, "current"), (5301, "expense", "opex", None)],
                                  "account_code int, root_type string, expense_class string, liquidity_class string")
    rates = spark.createDataFrame([(1, "2024-01-01", "2023-12-31"), (2, "2024-01-01", None)], "rate_id int, effective_from string, effective_to string")
    rates = rates.select("rate_id", F.col("effective_from").cast("date").alias("effective_from"), F.col("effective_to").cast("date").alias("effective_to"))
    found = k.validate_dims(parties, clients, chart, {"gst_rate": (rates, "rate_id")})
    assert sorted(tuple(r) for r in found.collect()) == sorted([
        ("DIM-UNIQUE", f"1/{full}"), ("DIM-GSTIN", "C4"), ("DIM-STATE", "5"), ("DIM-GSTIN", "6"), ("DIM-EXPENSE", "5300"), ("DIM-EXPENSE", "4300"),
        ("DIM-LIQUIDITY", "4300"), ("DIM-LIQUIDITY", "1300"), ("DIM-RANGE", "gst_rate/1")])


def test_a_round_of_mutual_choice_is_staged_once(spark, monkeypatch):
    from rokad.operators import pairing
    staged, own = [], pairing.stage
    monkeypatch.setattr(pairing, "stage", lambda df: staged.append(1) or own(df))
    # b is taken by y in the first round, so x falls to a in the second; c has nothing left
    pairs = spark.createDataFrame([("x", "b", 2), ("x", "a", 3), ("y", "b", 1), ("z", "b", 4)], "l string, r string, p int")
    got = pairing.mutual_best(pairs, [F.col("p")])
    assert {tuple(r) for r in got.collect()} == {("y", "b"), ("x", "a")}
    assert len(staged) == 3


def test_imported_sums_parse_a_line_once(spark, tmp_path):
    from decimal import Decimal as D

    from rokad.sources import imports
    head = "voucher_number,voucher_type,posting_date,account_name,debit,credit,party_name,party_gstin,party_pan"
    rows = ['V1,sales,01/04/2024,Cash,"₹ 1,200.50",,,,', "V1,sales,01/04/2024,Sales,,1200.50,,,", "V2,sales,31/02/2024,Cash,5.00,,,,", "V3,sales,01/04/2024,Cash,abc,,,,",
            "V4,sales,,Bank,1.00,,,,", "V5,sales,02/04/2024,Cash,2.00,2.00,,,", "V6,sales,02/04/2024,Cash,3.00,,X,07BAD,", "V7,sales,02/04/2024,Cash,4.00,,X,,aaaaa1111a"]
    (tmp_path / "a.csv").write_text("\n".join([head, *rows]) + "\n")
    lines = imports.read_csv_history(spark, str(tmp_path))
    assert {r["voucher_number"]: r["problem"] for r in lines.collect()} == {"V1": None, "V2": "date", "V3": "amount", "V4": "date", "V5": "one_sided", "V6": "gstin", "V7": "pan"}
    sums = imports.accepted_sums(lines)
    assert {tuple(r) for r in sums.collect()} == {("Cash", D("1200.50"), D("0.00")), ("Sales", D("0.00"), D("1200.50"))}
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    # one step makes the amount of a cell; a filter on the problem would make all of it again
    assert sum(line.count("decimal(21,3)") for line in plan.splitlines()) <= 2 and not [x for x in plan.splitlines() if "Filter" in x and "decimal(21,3)" in x]


def test_names_of_the_ledger_come_with_the_documents(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    own = t.parties.select("party_id", "party_name", F.col("gstin").alias("party_gstin"))
    cols = ["voucher_id", "account_code", "signed_paise", "party_id", "party_name", "party_gstin"]
    got, want = t.named_ledger.select(cols), t.ledger.join(own, "party_id", "left").select(cols)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
