"""Plain SQL over the given tables, used only to check the Spark jobs on another engine."""
from __future__ import annotations

import re

from .. import masters as m
from ..functions import gstin as g
from ..sources import projection as p

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def build(final: str) -> str:
    """Prefix a query with the common table expressions it names, in dependency order."""
    done: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in CTES:
            if name not in done and name not in path and re.search(rf"\b{name}\b", text):
                visit(CTES[name], (*path, name))
                done.append(name)

    visit(final, ())
    if not done:
        return final
    body = ",\n".join(f"{n} AS ({CTES[n]})" for n in done)
    return f"WITH RECURSIVE {body}\n{final}"


def arr(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def q(v) -> str:
    return "NULL" if v is None else ("true" if v is True else "false" if v is False else "'" + str(v).replace("'", "''") + "'")


def values(rows: list[tuple], cols: list[str]) -> str:
    kinds = dict(c.split(":") for c in cols)
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    names = list(kinds)
    return (f"SELECT {', '.join(f'CAST({n} AS {kinds[n]}) AS {n}' for n in names)} "
            f"FROM (VALUES {body}) t({', '.join(names)})")


def check_digit(first14: str) -> str:
    w = f"((instr('{g.ALPHABET}', substr({first14}, i, 1)) - 1) * (2 - i % 2))"
    return (f"substr('{g.ALPHABET}', CAST((36 - list_sum(list_transform(range(1, 15), lambda i: {w} // 36 + {w} % 36)) % 36) "
            "% 36 + 1 AS INTEGER), 1)")


def money(paise: str) -> str:
    return f"CAST(CAST({paise} AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2))"


def fy(date: str) -> str:
    return f"CAST(year({date}) - CASE WHEN month({date}) < 4 THEN 1 ELSE 0 END AS INTEGER)"


D2 = "DECIMAL(18,2)"
S = arr(p.CLIENT_STATES)
cte("chart", values(m.CHART, ["account_code:INTEGER", "account_name:VARCHAR", "root_type:VARCHAR", "account_type:VARCHAR",
                              "expense_class:VARCHAR", "liquidity_class:VARCHAR", "parent_code:INTEGER"]))
cte("chart_groups", values(m.CHART_GROUPS, ["code:INTEGER", "name:VARCHAR", "root_type:VARCHAR", "parent_code:INTEGER"]))
cte("gst_rates", values(m.GST_RATES, ["rate_id:INTEGER", "hsn_prefix:VARCHAR", "effective_from:DATE", "effective_to:DATE",
                                      "gst_rate:DECIMAL(5,2)", "cess_rate:DECIMAL(5,2)", "citation:VARCHAR"]))
cte("thresholds", values(m.THRESHOLDS, ["key:VARCHAR", "effective_from:DATE", "effective_to:DATE", "value:DECIMAL(18,2)"]))
cte("tds_sections", values(m.tds_rows(p.TDS_REVISIONS),
                           ["section_id:INTEGER", "tds_category:VARCHAR", "entity_type:VARCHAR", "tds_rate:DECIMAL(6,3)",
                            "single_threshold:DECIMAL(18,2)", "cumulative_threshold:DECIMAL(18,2)",
                            "full_on_crossing:BOOLEAN", "effective_from:DATE", "effective_to:DATE"]))
cte("clients", f"""
SELECT CAST(n_nationkey AS INTEGER) client_id, CAST(n_regionkey AS INTEGER) firm_id, n_name client_name,
  {S}[n_nationkey+1] state_code, {arr(p.BUSINESS_TYPES)}[n_nationkey % 5 + 1] business_type,
  f14 || {check_digit('f14')} gstin
FROM (SELECT *, {S}[n_nationkey+1] || 'AAACN' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || 'N1Z' f14 FROM nation)""")
cte("customers_x", f"""
SELECT c_custkey ck, 'C' || c_custkey party_id, c_name party_name, CAST(c_nationkey AS INTEGER) nation,
  CASE WHEN c_custkey % 20 = 9 THEN 'overseas' WHEN c_custkey % 20 = 19 THEN 'sez' WHEN c_custkey % 10 IN (6,7) THEN 'unregistered'
       WHEN c_custkey % 10 = 8 THEN 'registered_composition' ELSE 'registered_regular' END gst_category,
  CASE WHEN c_custkey % 20 = 9 THEN '96' ELSE {S}[c_nationkey+1] END state_code, CAST(c_acctbal AS {D2}) opening
FROM customer""")
cte("customers", f"""
SELECT *, CASE WHEN gst_category IN ('unregistered','overseas') THEN NULL
  WHEN ck % 97 = 5 THEN f14 || CASE WHEN {check_digit('f14')} = '0' THEN '1' ELSE '0' END
  ELSE f14 || {check_digit('f14')} END gstin
FROM (SELECT *, state_code || chr(CAST(65 + ck // 6760000 % 26 AS INTEGER)) || chr(CAST(65 + ck // 260000 % 26 AS INTEGER)) || chr(CAST(65 + ck // 10000 % 26 AS INTEGER)) || 'CC' || lpad(CAST(ck % 10000 AS VARCHAR), 4, '0') || 'C1Z' f14 FROM customers_x)""")
cte("suppliers", f"""
SELECT sk, party_id, party_name, nation, gst_category, state_code, opening,
  CASE WHEN gst_category <> 'unregistered' THEN f14 || {check_digit('f14')} END gstin
FROM (SELECT s_suppkey sk, 'S' || s_suppkey party_id, s_name party_name, CAST(s_nationkey AS INTEGER) nation,
  CASE WHEN s_suppkey % 10 = 9 THEN 'unregistered' WHEN s_suppkey % 10 = 8 THEN 'registered_composition' ELSE 'registered_regular' END gst_category,
  {S}[s_nationkey+1] state_code, CAST(s_acctbal AS {D2}) opening,
  {S}[s_nationkey+1] || chr(CAST(65 + s_suppkey // 6760000 % 26 AS INTEGER)) || chr(CAST(65 + s_suppkey // 260000 % 26 AS INTEGER)) || chr(CAST(65 + s_suppkey // 10000 % 26 AS INTEGER)) || 'CS' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') || 'S1Z' f14 FROM supplier)""")
cte("parties", """
SELECT party_id, 'customer' party_type, party_name, nation, gst_category, state_code, gstin, opening FROM customers
UNION ALL SELECT party_id, 'supplier', party_name, nation, gst_category, state_code, gstin, opening FROM suppliers""")
cte("doc_lines", f"""
SELECT *, (taxable_p * slab * 50 + 5000) // 10000 half_p, (taxable_p * slab * 100 + 5000) // 10000 full_p,
  CASE WHEN slab > 0 THEN (taxable_p * cess_pct * 100 + 5000) // 10000 ELSE 0 END cess_p,
  CASE WHEN slab = 0 THEN ['nil_rated','exempt','non_gst'][pk % 3 + 1] ELSE 'taxable' END treatment
FROM (SELECT *, price_p - (price_p * disc + 50) // 100 taxable_p, (price_p * disc + 50) // 100 discount_p
FROM (SELECT l_orderkey ok, l_suppkey sk, l_returnflag = 'R' is_return, l_partkey pk, l_linenumber line_number,
  CAST(l_quantity AS DECIMAL(18,3)) units, CAST(round(l_extendedprice * 100) AS BIGINT) price_p,
  CAST(round(l_discount * 100) AS BIGINT) disc,
  CAST({arr(p.SLABS)}[CAST(round(l_tax * 100) AS INTEGER) + 1] AS BIGINT) slab,
  {arr(p.HSN_CODES)}[l_partkey % 8 + 1] hsn, {arr(p.UOMS)}[l_partkey % 8 + 1] uom,
  CASE WHEN l_partkey % 8 = 7 THEN 5 ELSE 0 END cess_pct,
  CASE WHEN l_partkey % 5 = 0 THEN 4020 ELSE 4010 END income_account,
  {arr(p.EXPENSE_ACCOUNTS)}[(l_partkey // 8) % 8 + 1] expense_account FROM lineitem))""")
cte("orders_x", f"""
SELECT o_orderkey ok, o_custkey ck, o_orderstatus status, CAST(o_orderdate AS DATE) + {p.DATE_SHIFT} order_date,
  c.party_name customer_name, c.nation buyer, c.gst_category, c.gstin customer_gstin, c.state_code pos,
  b.firm_id buyer_firm, b.state_code buyer_state, b.business_type buyer_trade, b.gstin buyer_gstin
FROM orders JOIN customers c ON c.ck = o_custkey JOIN clients b ON b.client_id = c.nation""")
cte("sellers", """
SELECT sk, party_name supplier_name, nation seller, gst_category supplier_category, s.gstin supplier_gstin,
  c.firm_id seller_firm, c.state_code seller_state, c.gstin seller_gstin
FROM suppliers s JOIN clients c ON c.client_id = s.nation""")
cte("line_docs", """
SELECT *, gst_category = 'overseas' is_export, gst_category = 'overseas' AND ck % 40 <> 9 free_export,
  gst_category <> 'overseas' AND seller_state = pos intra, sk % 50 = 7 is_rcm,
  CASE WHEN is_return THEN order_date + 30 ELSE order_date END doc_date,
  CASE WHEN is_return THEN 'CN-' ELSE 'SI-' END || ok || '-' || sk invoice_id,
  CASE WHEN is_return THEN 'DN-' ELSE 'PB-' END || ok || '-' || sk bill_id,
  supplier_gstin IS NULL OR substr(supplier_gstin, 1, 2) = buyer_state bill_intra
FROM doc_lines JOIN orders_x USING (ok) JOIN sellers USING (sk)""")
cte("sales_lines", f"""
SELECT seller_firm firm_id, seller client_id, ok, sk, is_return, invoice_id voucher_id, doc_date posting_date, gst_category,
  pos place_of_supply, is_export, intra, is_rcm, pk, line_number, hsn, uom, units, slab, cess_pct,
  CASE WHEN free_export THEN 'zero_rated' ELSE treatment END treatment, income_account, taxable_p, price_p, discount_p,
  CASE WHEN NOT free_export AND intra THEN half_p ELSE 0 END cgst_p,
  CASE WHEN NOT free_export AND NOT intra THEN full_p ELSE 0 END igst_p,
  CASE WHEN NOT free_export THEN cess_p ELSE 0 END cess_due_p,
  ck, customer_name, customer_gstin, seller_gstin, seller_state, status FROM line_docs""")
cte("sales", f"""
SELECT *, grand_p - before_p round_off_p, NOT is_return AND ok % 37 = 0 is_reversed,
  CASE WHEN NOT is_return AND ok % 2 = 0 THEN 'REFN' || lpad(CAST(ok AS VARCHAR), 12, '0') END expected_reference FROM (
SELECT *, ((before_p + 50) // 100) * 100 grand_p FROM (
SELECT *, taxable_p + CASE WHEN is_rcm THEN 0 ELSE 2 * cgst_p + igst_p + cess_due_p END before_p FROM (
SELECT firm_id, client_id, voucher_id, ok, sk, is_return, 'C' || any_value(ck) party_id, any_value(customer_name) party_name,
  any_value(customer_gstin) party_gstin, any_value(gst_category) gst_category, any_value(seller_gstin) supplier_gstin,
  any_value(seller_state) supplier_state, any_value(place_of_supply) place_of_supply, any_value(posting_date) posting_date,
  any_value(status) status, bool_or(is_export) is_export, bool_or(intra) intra, bool_or(is_rcm) is_rcm,
  CASE WHEN bool_or(is_export) THEN CASE WHEN any_value(ck) % 40 = 9 THEN 'with_payment' ELSE 'without_payment' END END export_type,
  CAST(sum(taxable_p) AS BIGINT) taxable_p, CAST(sum(cgst_p) AS BIGINT) cgst_p, CAST(sum(igst_p) AS BIGINT) igst_p,
  CAST(sum(cess_due_p) AS BIGINT) cess_due_p,
  CAST(sum(CASE WHEN income_account = 4020 THEN taxable_p ELSE 0 END) AS BIGINT) rev_service_p, count(*) n_lines
FROM sales_lines GROUP BY ALL)))""")
cond = "CASE " + " ".join(
    f"WHEN expense_account = {a} THEN " + (
        "'blocked'" if rule == "blocked" else
        f"CASE WHEN buyer_trade IN ({', '.join(q(t) for t in m.BLOCKED_CATEGORIES[cat])}) THEN 'eligible' "
        "WHEN buyer_trade IS NOT NULL THEN 'blocked' ELSE 'conditional' END")
    for a, rule, cat in m.ITC_RULES) + " ELSE 'eligible' END"
cte("bill_parts", f"""
SELECT buyer_firm firm_id, buyer client_id, bill_id voucher_id, ok, sk, is_return, expense_account, any_value({cond}) itc,
  any_value(supplier_name) party_name, any_value(supplier_gstin) supplier_gstin, any_value(supplier_category) gst_category,
  any_value(buyer_gstin) recipient_gstin, any_value(buyer_state) place_of_supply, any_value(doc_date) bill_date,
  any_value(status) status, bool_or(is_rcm) is_rcm, bool_or(bill_intra) intra, CAST(sum(taxable_p) AS BIGINT) taxable_p,
  CAST(sum(CASE WHEN bill_intra THEN half_p ELSE 0 END) AS BIGINT) half_p,
  CAST(sum(CASE WHEN bill_intra THEN 0 ELSE full_p END) AS BIGINT) igst_p, count(*) n_lines
FROM line_docs GROUP BY ALL""")
cte("bills", """
SELECT *, 'S' || sk party_id, 'INV/' || ok || '/' || sk || CASE WHEN is_return THEN '/R' ELSE '' END bill_number,
  grand_p - before_p round_off_p,
  CASE WHEN intra THEN cgst_p + off ELSE cgst_p END stated_cgst_p, CASE WHEN intra THEN igst_p ELSE igst_p + off END stated_igst_p,
  CASE WHEN ok % 19 = 0 THEN 'pending_review' ELSE 'approved' END approval_status,
  CASE WHEN ok % 4 = 0 THEN 'ai_proposal' ELSE 'ui' END created_via,
  CASE WHEN ok % 4 = 0 AND ok % 100 = 0 THEN NULL ELSE 'u' || (ok % 7) END approved_by FROM (
SELECT *, CASE WHEN is_rcm THEN before_p ELSE ((before_p + 50) // 100) * 100 END grand_p,
  CASE WHEN ok % 23 = 0 THEN 1000 ELSE 0 END off FROM (
SELECT *, taxable_p + CASE WHEN is_rcm THEN 0 ELSE 2 * cgst_p + igst_p END before_p FROM (
SELECT firm_id, client_id, voucher_id, ok, sk, is_return, any_value(party_name) party_name, any_value(supplier_gstin) supplier_gstin,
  any_value(gst_category) gst_category, any_value(recipient_gstin) recipient_gstin, any_value(place_of_supply) place_of_supply,
  any_value(bill_date) bill_date, any_value(status) status, bool_or(is_rcm) is_rcm, bool_or(intra) intra,
  CAST(sum(taxable_p) AS BIGINT) taxable_p, CAST(sum(half_p) AS BIGINT) cgst_p, CAST(sum(igst_p) AS BIGINT) igst_p,
  CAST(sum(CASE WHEN itc = 'eligible' THEN half_p ELSE 0 END) AS BIGINT) claim_cgst_p,
  CAST(sum(CASE WHEN itc = 'eligible' THEN igst_p ELSE 0 END) AS BIGINT) claim_igst_p,
  CASE WHEN min(itc) = max(itc) THEN min(itc) ELSE 'mixed' END itc_eligibility, CAST(sum(n_lines) AS BIGINT) n_lines
FROM bill_parts GROUP BY ALL)))""")
cte("receipts", """
SELECT firm_id, client_id, 'RC-' || ok || '-' || sk voucher_id, ok, sk, party_id, party_name, voucher_id settles_voucher_id,
  posting_date + 30 receipt_date, CASE WHEN ok % 10 = 3 THEN 1010 ELSE 1020 END money_account,
  gross_p - tds_p cash_p, tds_p, taxable_p, grand_p FROM (
SELECT *, CASE WHEN status = 'F' THEN grand_p ELSE grand_p // 2 END gross_p,
  CASE WHEN status = 'F' AND ok % 7 = 0 THEN (taxable_p * 1000 + 5000) // 10000 ELSE 0 END tds_p
FROM sales WHERE NOT is_return AND NOT is_reversed AND status IN ('F','P'))""")
cte("payments", f"""
SELECT *, {fy('payment_date')} fy FROM (SELECT firm_id, client_id, 'PY-' || ok || '-' || sk voucher_id, ok, sk, party_id, party_name,
  voucher_id settles_voucher_id, bill_date + CASE WHEN ok % 11 = 0 THEN 200 ELSE 45 END payment_date,
  {arr(p.TDS_CATEGORIES)}[sk % 5 + 1] tds_category, {arr(p.ENTITIES)}[sk % 3 + 1] entity_type,
  CASE WHEN sk % 10 = 4 THEN 1010 ELSE 1020 END money_account,
  CASE WHEN status = 'F' THEN grand_p ELSE grand_p // 2 END amount_p
FROM bills WHERE NOT is_return AND status IN ('F','P'))""")
cte("tds_run", """
SELECT p.*, s.section_id, s.tds_rate, s.full_on_crossing fullx, CAST(s.single_threshold * 100 AS BIGINT) single_p,
  CAST(s.cumulative_threshold * 100 AS BIGINT) thr, CAST(s.tds_rate * 100 AS BIGINT) bp,
  CAST(sum(amount_p) OVER (PARTITION BY p.client_id, p.party_id, p.tds_category, p.fy ORDER BY payment_date, ok, sk) AS BIGINT) cum_p
FROM payments p LEFT JOIN tds_sections s ON s.tds_category = p.tds_category AND s.entity_type = p.entity_type
  AND payment_date >= s.effective_from AND payment_date <= coalesce(s.effective_to, DATE '9999-12-31')""")
cte("tds_step", """
SELECT *, row_number() OVER (PARTITION BY client_id, party_id, tds_category, fy ORDER BY payment_date, ok, sk) n,
  coalesce(cum_p >= thr AND thr > 0, false) is_over, coalesce(cum_p - amount_p >= thr AND thr > 0, false) was_over,
  CASE WHEN section_id IS NOT NULL AND single_p > 0 AND amount_p >= single_p THEN (amount_p * bp + 5000) // 10000 ELSE 0 END single_tax,
  ((CASE WHEN fullx THEN cum_p ELSE cum_p - thr END) * bp + 5000) // 10000 gross FROM tds_run""")
# the rule payment after payment: what has been withheld so far goes from row to row
cte("tds_held", """
SELECT DISTINCT client_id, party_id, tds_category, fy, CAST(0 AS BIGINT) n, CAST(0 AS BIGINT) held, CAST(0 AS BIGINT) tds_p FROM tds_step
UNION ALL SELECT client_id, party_id, tds_category, fy, n, held + tax, tax FROM (
SELECT s.*, h.held, CAST(CASE WHEN is_over THEN greatest(gross - h.held, 0) ELSE single_tax END AS BIGINT) tax
FROM tds_held h JOIN tds_step s ON s.client_id = h.client_id AND s.party_id = h.party_id AND s.tds_category IS NOT DISTINCT FROM h.tds_category AND s.fy = h.fy AND s.n = h.n + 1)""")
cte("tds_all", """
SELECT s.*, h.tds_p, CASE WHEN is_over AND fullx THEN cum_p WHEN is_over AND was_over THEN amount_p WHEN is_over THEN cum_p - thr
  WHEN single_tax > 0 THEN amount_p ELSE 0 END base_p
FROM tds_step s JOIN tds_held h ON s.client_id = h.client_id AND s.party_id = h.party_id AND s.tds_category IS NOT DISTINCT FROM h.tds_category AND s.fy = h.fy AND s.n = h.n""")


def legs(src: str, firm: str, client: str, vid: str, kind: str, date: str, rows: list[tuple], where: str = "true",
         opening: str = "false") -> str:
    out = []
    for account, amount, ptype, party, settles in rows:
        out.append(
            f"SELECT {firm} firm_id, {client} client_id, {vid} voucher_id, {kind} voucher_type, {date} posting_date, "
            f"ok doc_key, CAST({account} AS INTEGER) account_code, CAST({amount} AS BIGINT) amt, {ptype} party_type, "
            f"{party} party_id, {settles} settles_voucher_id, {opening} is_opening FROM {src} WHERE {where}")
    return " UNION ALL ".join(out)


N = "CAST(NULL AS VARCHAR)"


def _sales_rows(sign: str) -> list[tuple]:
    return [
        (1030, f"{sign} * grand_p", "'customer'", "party_id", N),
        (4010, f"-{sign} * (taxable_p - rev_service_p)", N, N, N),
        (4020, f"-{sign} * rev_service_p", N, N, N),
        (2021, f"-{sign} * CASE WHEN is_rcm THEN 0 ELSE cgst_p END", N, N, N),
        (2022, f"-{sign} * CASE WHEN is_rcm THEN 0 ELSE cgst_p END", N, N, N),
        (2023, f"-{sign} * CASE WHEN is_rcm THEN 0 ELSE igst_p END", N, N, N),
        (2024, f"-{sign} * CASE WHEN is_rcm THEN 0 ELSE cess_due_p END", N, N, N),
        (5199, f"-{sign} * round_off_p", N, N, N),
    ]


SG = "(CASE WHEN is_return THEN -1 ELSE 1 END)"
cte("legs_sales", legs("sales", "firm_id", "client_id", "voucher_id", "CASE WHEN is_return THEN 'credit_note' ELSE 'sales' END",
                       "posting_date", _sales_rows(SG)))
cte("legs_rev", legs("sales", "firm_id", "client_id", "'RV-' || voucher_id", "'sales'", "posting_date + 10",
                     _sales_rows("(-1)"), "is_reversed"))
cte("legs_bill", legs("bills", "firm_id", "client_id", "voucher_id", "CASE WHEN is_return THEN 'debit_note' ELSE 'purchase' END",
                      "bill_date", [
    (1041, f"{SG} * claim_cgst_p", N, N, N), (1042, f"{SG} * claim_cgst_p", N, N, N), (1043, f"{SG} * claim_igst_p", N, N, N),
    (2021, f"-{SG} * CASE WHEN is_rcm THEN cgst_p ELSE 0 END", N, N, N),
    (2022, f"-{SG} * CASE WHEN is_rcm THEN cgst_p ELSE 0 END", N, N, N),
    (2023, f"-{SG} * CASE WHEN is_rcm THEN igst_p ELSE 0 END", N, N, N),
    (2010, f"-{SG} * grand_p", "'supplier'", "party_id", N), (5199, f"{SG} * round_off_p", N, N, N)])
    + " UNION ALL " + legs("bill_parts", "firm_id", "client_id", "voucher_id",
                           "CASE WHEN is_return THEN 'debit_note' ELSE 'purchase' END", "bill_date", [
    ("expense_account", f"{SG} * (taxable_p + CASE WHEN itc = 'eligible' THEN 0 ELSE 2 * half_p + igst_p END)", N, N, N)]))
cte("legs_receipt", legs("receipts", "firm_id", "client_id", "voucher_id", "'receipt'", "receipt_date", [
    ("money_account", "cash_p", N, N, N), (1050, "tds_p", N, N, N),
    (1030, "-(cash_p + tds_p)", "'customer'", "party_id", "settles_voucher_id")]))
cte("legs_payment", legs("tds_all", "firm_id", "client_id", "voucher_id", "'payment'", "payment_date", [
    (2010, "amount_p", "'supplier'", "party_id", "settles_voucher_id"), (2030, "-tds_p", N, N, N),
    ("money_account", "-(amount_p - tds_p)", N, N, N)]))
cte("opening_parties", """
SELECT nation client_id, party_id, 'customer' party_type, 1030 account_code, CAST(opening * 100 AS BIGINT) amt FROM customers
UNION ALL SELECT nation, party_id, 'supplier', 2010, -CAST(opening * 100 AS BIGINT) FROM suppliers""")
cte("legs_opening", f"""
SELECT c.firm_id, c.client_id, 'OB-' || c.client_id voucher_id, 'opening' voucher_type, DATE '{p.OPENING_DATE}' posting_date,
  CAST(-1 AS BIGINT) doc_key, account_code, amt, party_type, party_id, {N} settles_voucher_id, true is_opening
FROM (SELECT client_id, party_id, party_type, CAST(account_code AS INTEGER) account_code, amt FROM opening_parties
  UNION ALL SELECT client_id, NULL, NULL, 1900, CAST(-sum(amt) AS BIGINT) FROM opening_parties GROUP BY client_id) o
JOIN clients c USING (client_id)""")
cte("ledger", f"""
SELECT *, {money('greatest(amt, 0)')} debit, {money('greatest(-amt, 0)')} credit, {fy('posting_date')} fy FROM (
SELECT * FROM legs_sales UNION ALL SELECT * FROM legs_rev UNION ALL SELECT * FROM legs_bill UNION ALL SELECT * FROM legs_receipt
UNION ALL SELECT * FROM legs_payment UNION ALL SELECT * FROM legs_opening) WHERE amt <> 0""")
