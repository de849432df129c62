"""Running totals, withholding, reports, matching and the chain against brute force on small tables."""
import random
from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from rokad import masters as m
from rokad.operators import matching as mt
from rokad.operators import tds
from rokad.operators.prefix import carry_forward, running_sum
from rokad.plans import audit, bank, reports
from rokad.sources import statements as st


def test_prefix_helpers_with_one_hot_key(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 5}", i // 7, i, rnd.randint(-9, 9), rnd.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, day int, id int, v int, w int").withColumn("c", F.floor(F.col("id") / 3))
    run = {r["id"]: r["s"] for r in running_sum(df, ["k"], ["day", "c"], ["day", "id"], {"s": F.col("v")}, "long").collect()}
    last = {r["id"]: r["p"] for r in carry_forward(df, ["k"], ["day", "c"], ["day", "id"], {"p": F.col("w")}).collect()}
    total, seen = {}, {}
    for k, _, i, v, w in rows:
        total[k] = total.get(k, 0) + v
        assert run[i] == total[k] and last[i] == seen.get(k)
        seen[k] = w if w is not None else seen.get(k)


def _sequential(rows, rate, single, thr, full):
    cum = taken = D(0)
    out = []
    half = D("0.01")
    tax = lambda base: (base * rate / 100).quantize(half, rounding="ROUND_HALF_UP")
    for pay in rows:
        before, cum = cum, cum + pay
        if thr > 0 and cum >= thr and full:
            t = max(tax(cum) - taken, D(0))
        elif thr > 0 and cum >= thr:
            t = tax(cum - thr) - (tax(before - thr) if before >= thr else D(0))
        else:
            t = tax(pay) if single > 0 and pay >= single else D(0)
        taken += t
        out.append(t)
    return out


def test_tds_matches_sequential_rule(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    cases = [("Contractor Payments", "company", D(2), D(30000), D(100000), True), ("Professional Fees", "individual", D(10), D(30000), D(50000), True),
             ("Purchase of Goods", "no_pan", D(5), D(0), D(5000000), False)]
    for party in range(30):
        cat, ent, rate, single, thr, full = cases[party % 3]
        pays = [D(rnd.randint(100, 6000000 if not full else 4500000)) / 100 * (100 if not full else 1) for _ in range(12)]
        for i, (p, t) in enumerate(zip(pays, _sequential(pays, rate, single, thr, full))):
            vid = f"{party}-{i}"
            rows.append((vid, 1, f"S{party}", i, 1, date(2026, 5, 1) + timedelta(days=i // 3), 2026, cat, ent, p))
            want[vid] = t
    df = spark.createDataFrame(rows, "voucher_id string, client_id int, party_id string, ok long, sk long, payment_date date, fy int, "
                               "tds_category string, entity_type string, amount decimal(18,2)")
    got = {r["voucher_id"]: r["tds"] for r in tds.compute(df, m.tds_sections(spark)).collect()}
    assert got == want


def test_withholding_with_rows_that_change_inside_a_year(spark):
    """One hot party over several years, its rate going up, then down: the scan equals the rule payment after payment."""
    rnd = random.Random(12)
    rows = [(1, "P", True, date(2022, 4, 1), date(2022, 9, 30), 200, 3000000, 12000000), (2, "P", True, date(2022, 10, 1), date(2022, 12, 31), 500, 2500000, 9000000),
            (3, "P", True, date(2023, 1, 1), date(2023, 8, 31), 100, 3000000, 9000000), (4, "P", False, date(2023, 9, 1), None, 25, 0, 4000000)]
    sections = spark.createDataFrame([(i, k, "company", D(bp) / 100, D(one) / 100, D(thr) / 100, full, start, end) for i, k, full, start, end, bp, one, thr in rows],
                                     "section_id int, tds_category string, entity_type string, tds_rate decimal(6,3), single_threshold decimal(18,2), "
                                     "cumulative_threshold decimal(18,2), full_on_crossing boolean, effective_from date, effective_to date")
    pays, want, state = [], {}, {}
    for i in range(400):
        on = date(2022, 4, 1) + timedelta(days=i * 2)
        paise, fy = rnd.choice([rnd.randint(1000, 900000), 3500000]), on.year - (on.month < 4)
        pays.append((1, "S1", f"V{i}", fy, on, i, 0, "P", "company", D(paise) / 100))
        paid, held = state.get(fy, (0, 0))
        _, _, full, _, _, bp, one, thr = next(r for r in rows if r[3] <= on and (r[4] is None or on <= r[4]))
        after = paid + paise
        if after >= thr:
            tax = max(0, ((after if full else after - thr) * bp + 5000) // 10000 - held)
        else:
            tax = (paise * bp + 5000) // 10000 if one and paise >= one else 0
        state[fy] = (after, held + tax)
        want[f"V{i}"] = D(tax) / 100
    df = spark.createDataFrame(pays, "client_id int, party_id string, voucher_id string, fy int, payment_date date, ok long, sk long, "
                                     "tds_category string, entity_type string, amount decimal(18,2)")
    got = {r["voucher_id"]: r["tds"] for r in tds.compute(df, sections).collect()}
    assert got == want and len({t for t in want.values()}) > 50


LEG = "client_id int, account_code int, posting_date date, debit decimal(18,2), credit decimal(18,2), is_opening boolean, finance_book_id string"


def _legs(spark, rows):
    return spark.createDataFrame([(1, a, date(2026, 5, 1), D(d), D(c), False, None) for a, d, c in rows], LEG)


def test_profit_and_loss_and_balance_sheet(spark):
    legs = _legs(spark, [(1020, 500000, 0), (4010, 0, 500000), (5010, 250000, 0), (1020, 0, 250000), (5110, 100000, 0), (1020, 0, 100000),
                         (5210, 10000, 0), (1020, 0, 10000), (1020, 45000, 0), (3010, 0, 45000)])
    chart = m.chart(spark)
    p = reports.profit_and_loss(legs, chart, "2026-04-01", "2027-03-31").first()
    assert (p["gross_profit"], p["operating_profit"], p["net_profit"]) == (D("250000.00"), D("150000.00"), D("140000.00"))
    s = reports.balance_sheet(legs, chart, "2027-03-31").first()
    assert (s["equity"], s["retained_profit"], s["balanced"]) == (D("45000.00"), D("140000.00"), True)


def test_cash_episode_is_reported_once(spark):
    rows = [(1, 1010, date(2026, 5, d), D(a if a > 0 else 0), D(-a if a < 0 else 0), False, None)
            for d, a in [(1, 20000), (12, -30000), (14, -100), (20, 50000), (25, -60000)]]
    got = bank.cash_register(spark.createDataFrame(rows, LEG), [1010], "2026-05-01", "2026-05-31").orderBy("date").collect()
    assert [(r["date"].day, r["balance"]) for r in got] == [(12, D("-10000.00")), (25, D("-20100.00"))]


@pytest.mark.parametrize(("small", "hot"), [(64, False), (2, False), (0, False), (5, True)])
def test_matcher_equals_brute_force(spark, monkeypatch, small, hot):
    """Small classes meet their lines whole; large ones by the first four from three dates on. hot: one party has all documents."""
    monkeypatch.setattr(mt, "SMALL", small)
    rnd = random.Random(3)
    start = date(2026, 1, 1)
    docs = [(1, "in", f"V{i:03}", rnd.choice([1180000, rnd.randint(5000, 3000000)]), start + timedelta(days=rnd.randint(0, 200)),
             rnd.choice([None, f"R{i % 9}"]), "P1" if hot else f"P{i % 6}") for i in range(150)]
    lines = [(1, "in", f"L{i:03}", rnd.choice([1180000, rnd.randint(1, 3000000)]), start + timedelta(days=rnd.randint(0, 200)),
              rnd.choice([None, f"R{i % 11}"]), rnd.choice([None, "P1" if hot else f"P{i % 8}"])) for i in range(60)]
    d = spark.createDataFrame(docs, "client_id int, dir string, voucher_id string, due long, document_date date, d_ref string, d_party string")
    ln = spark.createDataFrame(lines, "client_id int, dir string, line_id string, amt long, txn_date date, l_ref string, l_party string")
    got = {(r["line_id"], r["rank"]): (r["voucher_id"], r["score"]) for r in mt.rank(mt.candidates(ln, d)).collect()}
    want = {}
    for _, _, lid, amt, on, ref, party in lines:
        best = []
        for _, _, vid, due, dd, dref, dparty in docs:
            gap, days = abs(due - amt), abs((on - dd).days)
            s = (50 if ref and ref == dref else 0) + (30 if amt == due else 15 if gap <= 10000 or gap * 100 <= due * 12 else 0)
            s += (15 if party and party == dparty else 0) + (5 if days <= 3 else 2 if days <= 30 else 0)
            if s >= 15:
                best.append((-s, dd, vid))
        for n, (s, _, vid) in enumerate(sorted(best)[:4], 1):
            want[(lid, n)] = (vid, -s)
    assert got == want


def test_allocation_oldest_first(spark):
    r = spark.createDataFrame([(1, "P", "R1", date(2026, 1, 1), D(150), 1, 1), (1, "P", "R2", date(2026, 1, 2), D(100), 2, 1)],
                              "client_id int, party_id string, receipt_id string, receipt_date date, amount decimal(18,2), ok long, sk long")
    d = spark.createDataFrame([(1, "P", f"I{i}", date(2026, 1, i), D(100), i, 1) for i in (1, 2, 3)],
                              "client_id int, party_id string, voucher_id string, document_date date, due decimal(18,2), ok long, sk long")
    got = sorted((x["receipt_id"], x["voucher_id"], x["amount"]) for x in mt.allocate(r, d).collect())
    assert got == [("R1", "I1", D("100.00")), ("R1", "I2", D("50.00")), ("R2", "I2", D("50.00")), ("R2", "I3", D("50.00"))]


def test_records_and_cells(spark):
    text = ['Date,Narration,Debit,Credit,Balance', '01/05/2026,"A, B', 'second ""line""",100.00,,900.00', '', '02/05/2026,C,,50.00,950.00']
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file_id string, line_no long, line string")
    recs = st.records(df)
    got = [r["cells"] for r in st.cells(recs, st.delimiters(recs)).orderBy("line_no").collect()]
    assert got[1] == ["01/05/2026", 'A, B\nsecond "line"', "100.00", "", "900.00"] and len(got) == 3


def test_chain_detects_tampering(spark):
    rows = spark.sql("""SELECT id, CAST(id % 2 AS INT) firm_id, 1 client_id, 'v' entity_type, id entity_id, 'create' action, CAST(NULL AS STRING) before,
        concat('{"n":', id, '}') after, 'u1' actor_user_id, 'human' actor_type, CAST(NULL AS STRING) ai_model, CAST(NULL AS STRING) approved_by,
        timestamp'2026-01-01 00:00:00' occurred_at FROM range(40)""")
    sealed = audit.seal_segments(rows, ["firm_id"])
    assert all(r["ok"] for r in audit.verify(sealed, ["firm_id"]).collect())
    bad = sealed.withColumn("after", F.when(F.col("id") == 9, "x").otherwise(F.col("after")))
    assert {r["firm_id"]: r["broken_at"] for r in audit.verify(bad, ["firm_id"]).collect()} == {0: None, 1: 9}


def test_a_lost_segment_is_seen(spark):
    from rokad.plans import audit
    rows = [(firm, seg, seg * 10 + i, f"{firm}-{seg}-{i}") for firm in (1, 2) for seg in range(4) for i in range(3)]
    sealed = spark.createDataFrame(rows, "firm_id int, segment int, id long, row_hash string")
    links = audit.link_segments(audit.segment_facts(sealed, ["firm_id"], "segment"), ["firm_id"], "segment")

    def broken(kept):
        return {r.firm_id: r.broken_at for r in audit.verify_segments(kept, links, ["firm_id"], "segment").collect()}

    assert broken(sealed) == {1: None, 2: None}
    assert broken(sealed.filter("NOT (firm_id = 2 AND segment = 1)")) == {1: None, 2: 1}
    assert broken(sealed.filter("NOT (firm_id = 1 AND id = 32)")) == {1: 3, 2: None}


def test_charts_of_any_depth():
    import pytest
    from rokad.plans.books import ancestors
    deep = [(1, "a", "asset", None), (2, "b", "asset", 1), (3, "c", "asset", 2), (4, "d", "asset", 3)]
    assert (4, 1) in ancestors(deep) and len(ancestors(deep)) == 10
    with pytest.raises(ValueError):
        ancestors([(1, "a", "asset", 2), (2, "b", "asset", 1)])


def test_unused_credit_goes_to_the_next_month(spark):
    from decimal import Decimal as D

    from rokad.plans.returns import set_off
    names = [*[f"{side}_{h}" for side in ("out", "itc") for h in ("igst", "cgst", "sgst")], "rcm_igst", "rcm_cgst", "rcm_sgst"]
    schema = "client_id int, period string, " + ", ".join(f"{n} decimal(18,2)" for n in names)
    months = {"2025-04": dict(out_cgst=50, itc_cgst=80), "2025-05": dict(out_cgst=-20, out_sgst=10, itc_igst=4), "2025-06": dict(out_cgst=60, rcm_igst=5)}
    df = spark.createDataFrame([(1, p, *[D(v.get(n, 0)) for n in names]) for p, v in months.items()], schema)
    got = {r.period: r for r in set_off(df).collect()}
    assert (got["2025-04"].cash_cgst, got["2025-04"].left_cgst) == (0, 30)
    assert (got["2025-05"].use_igst_sgst, got["2025-05"].cash_sgst, got["2025-05"].left_cgst) == (4, 6, 30)
    # 60 less the 20 of May's credit notes, 30 of credit kept
    assert (got["2025-06"].use_cgst_cgst, got["2025-06"].cash_cgst, got["2025-06"].cash_rcm) == (30, 10, 5)
