"""Two-sided matching, vendors, rules, settlements, divergence and order against plain versions, with one hot key each."""
import random
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal as D

from pyspark.sql import functions as F

from rokad.operators import inward, pairing, rules, sorting, vendor
from rokad.operators import matching as mt
from rokad.plans import returns

BILL = ("voucher_id string, client_id int, supplier_gstin string, bill_number string, bill_date date, taxable decimal(18,2), cgst decimal(18,2), sgst decimal(18,2), "
        "igst decimal(18,2), is_return boolean")
LINE = ("line_id string, client_id int, supplier_gstin string, invoice_number string, invoice_date date, taxable decimal(18,2), cgst decimal(18,2), sgst decimal(18,2), "
        "igst decimal(18,2), is_amended boolean, ims_action string")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_pairs(bills, lines, manual):
    """The passes one after the other; the last one takes the best pair left again and again."""
    number = lambda s: "".join(c for c in s if c.isalnum()).upper()
    b = {r[0]: (r[1], r[2], number(r[3]), r[3], r[4], int(r[5] * 100), int((r[6] + r[7] + r[8]) * 100)) for r in bills if r[2] and not r[9]}
    g = {r[0]: (r[1], r[2], number(r[3]), r[3], r[4], int(r[5] * 100), int((r[6] + r[7] + r[8]) * 100)) for r in lines}
    pairs = {}

    def left(side, end):
        used = {p[end] for p in pairs}
        return {k: v for k, v in side.items() if k not in used}

    for c, s, x, y in manual:
        for k, v in b.items():
            for k2, v2 in g.items():
                if v[:2] == v2[:2] == (c, s) and (v[3], v2[3]) == (x, y):
                    pairs[k, k2] = "manual"
    for how, key, order in (("number", lambda v: v[:3], lambda v: v[4:6]), ("value", lambda v: (v[0], v[1], v[4], v[5], v[6]), lambda v: v[2])):
        groups = defaultdict(lambda: ([], []))
        for end, side in enumerate((b, g)):
            for k, v in left(side, end).items():
                groups[key(v)][end].append((order(v), k))
        for x, y in groups.values():
            for (_, k), (_, k2) in zip(sorted(x), sorted(y), strict=False):
                pairs[k, k2] = how
    near = []
    for k, v in left(b, 0).items():
        for k2, v2 in left(g, 1).items():
            if v[:2] == v2[:2]:
                gap, e = abs((v[4] - v2[4]).days), edits(v[2], v2[2])
                close = abs(v[5] - v2[5]) <= 100 and abs(v[6] - v2[6]) <= 100 and gap <= 5
                if close or gap == 0 and e <= 1:
                    near.append((-2 * close - 2 * (e <= 1), e, gap, k, k2))
    used = set()
    for *_, k, k2 in sorted(near):
        if not {k, k2} & used:
            used |= {k, k2}
            pairs[k, k2] = "near"
    return pairs


def test_inward_reconciliation_of_a_hot_supplier(spark):
    rnd = random.Random(21)
    day = lambda n: date(2026, 1, 1) + timedelta(days=n)
    bills, lines = [], []
    for i in range(160):
        supplier = "HOT" if i % 5 else f"S{i % 7}"
        bills.append((f"V{i:03}", 1, supplier, f"INV/{i:03}/A", day(rnd.randint(0, 30)), D(rnd.choice([100, 250, 999])) + D(i % 3) / 4, D(9), D(9), D(0), i % 40 == 39))
    for i, r in enumerate(bills):
        k = rnd.randint(0, 9)
        if k == 0:
            continue
        number = {1: r[3].lower().replace("/", "-"), 2: "1NV" + r[3][3:], 3: f"Z{i}", 4: f"Q{rnd.randint(0, 9)}", 5: r[3]}.get(k, r[3])
        when = r[4] + timedelta(days=rnd.choice([0, 0, 1, -3, 7]) if k in (2, 3, 4) else 0)
        lines.append((f"G{i:03}", 1, r[2], number, when, r[5] + rnd.choice([0, 0, D("0.5"), 40]) * (k in (3, 4, 6)), D(9), D(9), D(0), k == 7, rnd.choice(["accept", "accept", "pending", "reject"])))
    lines += [(f"X{i}", 1, "HOT", bills[i][3], bills[i][4], bills[i][5], D(9), D(9), D(0), False, "accept") for i in range(1, 9)]  # numbers twice
    manual = [(1, bills[11][2], bills[11][3], lines[30][3])] if lines[30][2] == bills[11][2] else [(1, "HOT", bills[11][3], next(x[3] for x in lines if x[3].startswith("Z")))]
    got = inward.reconcile(spark.createDataFrame(bills, BILL), spark.createDataFrame(lines, LINE),
                           spark.createDataFrame(manual, "client_id int, supplier_gstin string, bill_number string, invoice_number string")).collect()
    number_of = {r[0]: r[3] for r in lines}
    want = Counter((k, number_of[k2], how) for (k, k2), how in plain_pairs(bills, lines, manual).items())
    assert Counter((r["voucher_id"], r["invoice_number"], r["matched_by"]) for r in got if r["matched_by"]) == want
    assert {"manual", "number", "value", "near"} == {how for *_, how in want}
    assert len(got) == sum(not r[9] for r in bills) + len(lines) - sum(want.values())
    assert all((r["status"] == "missing_in_2b") == (r["invoice_number"] is None) and (r["status"] == "missing_in_books") == (r["voucher_id"] is None) for r in got)


def test_mutual_best_is_the_greedy_choice(spark):
    """A chain of candidates in which every round settles one pair, ties, and a hot end."""
    rnd = random.Random(6)
    rows = [(f"l{i}", f"r{i}", i) for i in range(9)] + [(f"l{i}", f"r{i + 1}", i) for i in range(9)] + [("hot", f"r{rnd.randint(0, 30)}", rnd.randint(0, 9)) for _ in range(40)]
    rows += [(f"l{rnd.randint(0, 30)}", f"r{rnd.randint(0, 30)}", rnd.randint(0, 20)) for _ in range(200)]
    got = {tuple(r) for r in pairing.mutual_best(spark.createDataFrame(rows, "l string, r string, s int"), [F.col("s")]).collect()}
    used, want = set(), set()
    for _, a, b in sorted((s, a, b) for a, b, s in rows):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    assert got == want
    assert pairing.mutual_best(spark.createDataFrame([], "l string, r string, s int"), [F.col("s")]).count() == 0


def test_vendor_by_number_name_and_history(spark):
    rnd = random.Random(3)
    kinds = ["Trading Company", "Industries", "Traders", "Private Limited"]
    vendors = [(c, f"S{i}", f"{rnd.choice(['Shree', 'Metro', 'City'])} {rnd.choice(['Ram', 'Steel', 'Foods'])} {rnd.choice(['', i])} {rnd.choice(kinds)}", f"G{i}" if i % 4 else None)
               for i in range(40) for c in ((1, 2) if i % 3 else (1,))]
    vendors = [(c, p, next(v[2] for v in vendors if v[1] == p), n) for c, p, _, n in vendors]
    docs = []
    for i in range(300):
        c, party, name, number = rnd.choice([v for v in vendors if v[0] == 1] if i % 4 else vendors)  # one client has most
        kind = rnd.randint(0, 6)
        text = {0: name.upper().replace("TRADING COMPANY", "TRDG. CO"), 1: " ".join(name.split()[:-1]), 2: f"alias {party}", 3: None, 4: f"stranger {i}"}.get(kind, name)
        docs.append((f"D{i}", c, text, number if kind in (2, 3, 5) and rnd.random() < 0.7 else None))
    got = {r["document_id"]: (r["party_id"], r["found_by"], r["score"]) for r in vendor.resolve_vendor(
        spark.createDataFrame(docs, "document_id string, client_id int, name string, gstin string"),
        spark.createDataFrame(vendors, "client_id int, party_id string, party_name string, gstin string")).collect()}

    import re
    words = lambda t: {vendor.SHORT_FORMS.get(w, w) for w in re.split("[^a-z0-9]+", t.lower()) if w}
    names = {p: words(n) for _, p, n, _ in vendors}
    held = Counter(w for ws in names.values() for w in ws)
    weight = lambda ws: sum((len(names) // max(1, held[w])).bit_length() for w in ws)
    want, habit = {}, defaultdict(Counter)
    for d, c, text, number in docs:
        hit = min((p for c2, p, _, n in vendors if c2 == c and n == number), default=None) if number else None
        if hit:
            want[d] = (hit, "number", None)
            if text is not None:
                habit[c, text][hit] += 1
    for d, c, text, number in docs:
        if d in want:
            continue
        best = min(((-(weight(words(text) & names[p]) * 1000 // weight(words(text) | names[p])), p) for c2, p, _, _ in vendors
                    if text is not None and c2 == c and weight(words(text) & names[p]) * 100 >= 60 * weight(words(text) | names[p])), default=None)
        if best:
            want[d] = (best[1], "name", -best[0])
        elif habit[c, text]:
            want[d] = (min(habit[c, text], key=lambda p: (-habit[c, text][p], p)), "history", None)
        else:
            want[d] = (None, "unmatched", None)
    assert got == want and {"number", "name", "history", "unmatched"} == {x[1] for x in want.values()}


def test_required_literals():
    for pattern, literal in [("ATM WDL [0-9]{3}[02468] +MAIN", "ATM WDL "), ("a|b", ""), ("(?i)upi/(\\d+)/pay", "UPI/"), ("x?", ""), ("(abc)+d", "ABC"), ("[", ""), ("ab{2}c", "A"), (None, ""),
                             ("^NEFT(-| )REF", "NEFT"), ("(foo|bar)baz", "BAZ")]:
        assert rules.required_literal(pattern) == literal


def test_rules_of_a_hot_client(spark):
    rnd = random.Random(7)
    texts = ["NEFT-REFN000017-CUSTOMER#1", "ATM WDL 0042 MAIN", "SMS CHARGES QTR", "", "UPI/123/PAY me", "neft misc"]
    lines = [(1 if i % 8 else 2, f"L{i}", rnd.choice(texts), rnd.choice([None, "charge", "upi"]), D(rnd.choice([0, 50])), D(rnd.choice([0, 700]))) for i in range(300)]
    told = [(1, 11, 5, "ATM", None, None, None, None, None, "20", "a", 1), (1, 12, 1, None, None, "REFN0+[0-9]+-(CUST|SUPP)", None, "credit", None, None, "b", 2),
            (1, 13, 3, None, "charges", None, "charge", None, None, None, "c", 3), (2, 21, 9, None, None, None, None, None, "10", None, "d", 4), (1, 14, 8, None, None, None, "upi", None, None, None, "e", 5),
            (1, 15, 4, None, "CH", None, None, None, None, None, "f", 6), (1, 16, 2, None, None, "^(NEFT|UPI/[0-9]{4})", None, None, "100", "900", "g", 7)]
    got = {r["line_id"]: r["rule_id"] for r in rules.apply_rules(
        spark.createDataFrame(lines, "client_id int, line_id string, narration string, payment_mode string, debit decimal(18,2), credit decimal(18,2)"),
        spark.createDataFrame([(*r[:8], *(x and D(x) for x in r[8:10]), *r[10:]) for r in told], "client_id int, rule_id int, priority int, starts_with string, contains string, regex string, "
                              "payment_mode string, direction string, amount_min decimal(18,2), amount_max decimal(18,2), action string, target_account int")).collect()}
    import re
    want = {}
    for c, own, text, mode, debit, credit in lines:
        n, amount, direction = text.upper(), debit + credit, "debit" if debit > 0 else "credit"
        for rc, rid, _, sw, co, rx, rm, rd, lo, hi, *_ in sorted(told, key=lambda r: (r[2], r[1])):
            if rc == c and (not sw or n.startswith(sw.upper())) and (not co or co.upper() in n) and (not rx or re.search(rx, n)) and (not rm or rm == mode) and (
                    not rd or rd == direction) and (not lo or amount >= D(lo)) and (not hi or amount <= D(hi)):
                want[own] = rid
                break
    assert got == want and len(set(want.values())) == len(told)


def test_settlement_ranges(spark):
    rnd = random.Random(9)
    day = lambda n: date(2026, 1, 1) + timedelta(days=n)
    sums = {(a, n): D(rnd.choice([100, 100, 250, 75])) for a in (1, 2) for n in range(120) if rnd.random() < (0.9 if a == 1 else 0.1)}
    credits = []
    for i in range(80):
        a, n = rnd.choice(sorted(sums))
        days = rnd.randint(1, 9)
        total = sum(sums.get((a, x), D(0)) for x in range(n, n + days))
        credits.append((7, a, f"B{i}", day(n + days - 1 + rnd.randint(0, 4)), total + rnd.choice([0, 0, 0, 1])))
    collections = [(7, a, day(n), v) for (a, n), v in sums.items()]
    got = {(r["account_id"], r["txn_date"]): (r["settled_on"], r["line_id"]) for r in mt.settlement_batches(
        spark.createDataFrame(collections, "client_id int, account_id int, txn_date date, credit decimal(18,2)"),
        spark.createDataFrame(credits, "client_id int, account_id int, line_id string, txn_date date, credit decimal(18,2)")).collect()}
    want = {(a, day(n)): (None, None) for a, n in sums}
    for _, a, own, on, total in sorted(credits, key=lambda r: (r[3], r[2])):
        days = sorted(n for b, n in sums if b == a)
        fits = [(j, i) for i in days for j in days if i <= j < i + 7 and 0 <= (on - day(j)).days <= 3 and sum(sums[a, x] for x in days if i <= x <= j) == total]
        if fits:
            j, i = max(fits)
            for n in days:
                if i <= n <= j and want[a, day(n)] == (None, None):
                    want[a, day(n)] = (on, own)
    assert got == want and sum(v[0] is not None for v in want.values()) > 30


def test_ledger_divergence(spark):
    ours = [(c, "igst", date(2026, 1, 1) + timedelta(days=i), 100 + i) for c in (1, 2, 3) for i in range(90)]
    theirs = [r for r in ours if r[0] == 1] + [(2, "igst", d + timedelta(days=3 if d == date(2026, 2, 4) else 0), p) for c, _, d, p in ours if c == 2]
    theirs += [(3, "igst", d, p) for c, _, d, p in ours if c == 3 and d != date(2026, 1, 20)] + [(4, "cgst", date(2026, 1, 1), 5)]
    schema = "client_id int, head string, entry_date date, amount_p long"
    got = {r["client_id"]: (r["first_apart"], r["first_gap"], r["closing_gap"], r["status"]) for r in returns.ledger_divergence(
        spark.createDataFrame(ours, schema), spark.createDataFrame(theirs, schema)).collect()}
    assert got == {1: (None, None, D("0.00"), "equal"), 2: (date(2026, 2, 4), D("1.34"), D("0.00"), "met_again"), 3: (date(2026, 1, 20), D("1.19"), D("1.19"), "apart"),
                   4: (date(2026, 1, 1), D("-0.05"), D("-0.05"), "apart")}


def test_sorted_files_and_positions(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, *"abc"]), rnd.choice([None, 1, 2, 3])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, name string, rank int").repartition(7)
    key = lambda r: (r[1] is None, r[1] or "", r[2] is None, -(r[2] or 0), r[0])
    want = [r[0] for r in sorted(rows, key=key)]
    sorting.write_sorted(df, str(tmp_path / "out"), "name", "-rank", "id")
    read = []
    for part in sorted(p for p in (tmp_path / "out").iterdir() if p.suffix == ".parquet"):
        read += [r["id"] for r in spark.read.parquet(str(part)).collect()]
    assert read == want
    got = sorted((r["position"], r["id"]) for r in sorting.with_position(df, "name", "-rank", "id").collect())
    assert got == list(enumerate(want, 1))
