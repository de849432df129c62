"""Check queries for the further books, audit and lineage jobs."""
from __future__ import annotations

from ..functions import gstin as g
from .. import masters as m
from .base import build, check_digit, cte, fy, money, q
from .reports import AS_OF, FROM, TO
from .tax import WHY

cte("doc_legs", "SELECT *, CAST(year(posting_date) - CASE WHEN month(posting_date) < 4 THEN 1 ELSE 0 END AS INTEGER) fy FROM (SELECT * FROM legs_sales UNION ALL SELECT * FROM legs_rev UNION ALL SELECT * FROM legs_bill UNION ALL SELECT * FROM legs_receipt) WHERE amt <> 0")
cte("chart_up", "SELECT code leaf, code FROM chart_groups UNION ALL SELECT u.leaf, g.parent_code FROM chart_up u JOIN chart_groups g ON g.code = u.code WHERE g.parent_code IS NOT NULL")
cte("vouchers", """
SELECT *, CASE WHEN ok % 4 = 0 THEN 'ai_proposal' ELSE 'ui' END created_via, 'u' || (ok % 7) created_by,
  CASE WHEN ok % 4 = 0 AND ok % 100 = 0 THEN NULL ELSE 'u' || (ok % 5) END approved_by,
  posting_date + CAST(CASE WHEN ok % 17 = 0 THEN 40 ELSE ok % 3 END AS INTEGER) entered_on, ok % 16 = 4 ai_edited, CASE WHEN ok % 74 = 0 THEN coalesce(reverses_id, voucher_id) ELSE voucher_id END voucher_number FROM (
SELECT client_id, voucher_id, CASE WHEN is_return THEN 'credit_note' ELSE 'sales' END voucher_type, posting_date, ok, NULL reverses_id FROM sales
UNION ALL SELECT client_id, 'RV-' || voucher_id, 'sales', posting_date + 10, ok, voucher_id FROM sales WHERE is_reversed
UNION ALL SELECT client_id, voucher_id, CASE WHEN is_return THEN 'debit_note' ELSE 'purchase' END, bill_date, ok, NULL FROM bills)""")
cte("rollup_m", "SELECT client_id, account_code, strftime(posting_date, '%Y-%m') period, sum(greatest(amt,0)) d, sum(greatest(-amt,0)) c FROM ledger GROUP BY 1, 2, 3")
cte("numbered", f"SELECT *, row_number() OVER (PARTITION BY client_id, f ORDER BY posting_date, ok, sk) n FROM (SELECT *, {fy('posting_date')} f FROM sales WHERE NOT is_return)")
cte("audit_rows", """
SELECT event_id id, CAST(user_id % 5 AS INTEGER) firm_id, CAST(user_id % 25 AS INTEGER) client_id, CAST(event_id // 4096 AS INTEGER) segment, event_type entity_type, user_id entity_id,
  CASE event_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'approve' ELSE 'reverse' END "action", props "after", 'u' || (user_id % 7) actor_user_id,
  CASE WHEN event_id % 10 = 0 THEN 'ai' WHEN event_id % 50 = 1 THEN 'support' ELSE 'human' END actor_type,
  CASE WHEN event_id % 10 = 0 THEN 'm1' ELSE '' END ai_model, CASE WHEN event_id % 10 = 0 THEN 'u' || (event_id % 5) ELSE '' END approved_by, ts occurred_at FROM events""")
PAY = "concat_ws('|', firm_id, client_id, entity_type, entity_id, \"action\", '', coalesce({}, ''), actor_user_id, actor_type, ai_model, approved_by, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00')"
cte("audit_pos", f"SELECT *, {PAY.format('\"after\"')} pay, row_number() OVER (PARTITION BY firm_id, segment ORDER BY id) rn FROM audit_rows")
cte("sealed", f"""
SELECT id, firm_id, segment, rn, repeat('0', 64) prev_hash, sha256(repeat('0', 64) || '|' || pay) row_hash FROM audit_pos WHERE rn = 1
UNION ALL SELECT p.id, p.firm_id, p.segment, p.rn, s.row_hash, sha256(s.row_hash || '|' || p.pay) FROM sealed s JOIN audit_pos p
  ON p.firm_id = s.firm_id AND p.segment = s.segment AND p.rn = s.rn + 1""")
cte("segments", "SELECT firm_id, segment, count(*) n, max(id) last_id, arg_max(row_hash, id) digest, row_number() OVER (PARTITION BY firm_id ORDER BY segment) pos FROM sealed GROUP BY 1, 2")
cte("segment_links", """
SELECT firm_id, segment, n, last_id, digest, pos, repeat('0', 64) prev_link, sha256(concat_ws('|', repeat('0', 64), segment, n, last_id, digest)) link FROM segments WHERE pos = 1
UNION ALL SELECT s.firm_id, s.segment, s.n, s.last_id, s.digest, s.pos, l.link, sha256(concat_ws('|', l.link, s.segment, s.n, s.last_id, s.digest))
FROM segment_links l JOIN segments s ON s.firm_id = l.firm_id AND s.pos = l.pos + 1""")
cte("closed_m", "SELECT DISTINCT client_id, date_trunc('month', posting_date) ps FROM sales WHERE ok % 50 = 0")
cte("recon_status", "SELECT voucher_id, status FROM recon WHERE status = 'missing_in_2b'")


def ag(src: str) -> str:
    def part(c: str, n: str) -> str:
        return f"{money(f'coalesce(sum(CASE WHEN {c} THEN due END), 0)')} {n}"
    return build(f"SELECT client_id, party_id, {part('a <= 30', 'd0_30')}, {part('a > 30 AND a <= 60', 'd31_60')}, {part('a > 60 AND a <= 90', 'd61_90')}, {part('a > 90 AND a <= 180', 'd91_180')}, {part('a > 180', 'over_180')}, {money('sum(due)')} total FROM (SELECT *, DATE '{AS_OF}' - document_date a FROM {src}) WHERE a >= 0 GROUP BY 1, 2")


def dc(expr: str = "amt") -> str:
    return f"{money(f'greatest({expr}, 0)')} debit, {money(f'greatest(-({expr}), 0)')} credit"


KEY = "voucher_id || '/' || account_code"
REG = "gst_category NOT IN ('unregistered','overseas')"


def why(col: str) -> str:
    return WHY.replace("upper(trim(gstin))", f"upper(trim({col}))").replace("gstin IS NULL", f"{col} IS NULL")


def rules(rows: list[tuple[str, str, str, str]]) -> str:
    return build(" UNION ALL ".join(f"SELECT '{r}' \"rule\", {k} \"key\" FROM {src} WHERE {cond}" for r, k, src, cond in rows))


OKS = "(" + ", ".join(f"'{s}'" for s in g.STATE_CODES) + ")"
cte("entered", """
SELECT client_id, party_id, voucher_id, bill_number, bill_date, grand_p FROM bills WHERE NOT is_return
UNION ALL SELECT client_id, party_id, 'PX-' || voucher_id, CASE WHEN ok % 120 = 0 THEN bill_number ELSE lower(replace(bill_number, '/', ' ')) END, bill_date, grand_p FROM bills WHERE NOT is_return AND ok % 60 = 0""")
SQL = {
    "normal_balance": build(f"""SELECT client_id, account_code, account_name, CASE WHEN root_type IN ('asset', 'expense') <> (account_type = 'accumulated_depreciation' OR lower(account_name) = 'drawings') THEN 'debit' ELSE 'credit' END normal,
 {money('net_p')} net, (net_p < 0) = (root_type IN ('asset', 'expense') <> (account_type = 'accumulated_depreciation' OR lower(account_name) = 'drawings')) abnormal
FROM (SELECT client_id, account_code, sum(amt) net_p FROM ledger WHERE posting_date <= DATE '{AS_OF}' GROUP BY 1, 2) JOIN chart USING (account_code) WHERE net_p <> 0"""),
    "duplicate_bills": build(f"""SELECT client_id, party_id, upper(regexp_replace(bill_number, '[^A-Za-z0-9]', '', 'g')) number, {money('grand_p')} grand_total, count(*) copies,
 min((bill_date, voucher_id))[2] first_voucher FROM entered GROUP BY 1, 2, 3, grand_p HAVING count(*) > 1"""),
    "scope": build(f"SELECT firm_id, client_id, voucher_id, {money('grand_p')} grand_total FROM sales WHERE firm_id = 2"),
    "voucher_status": build("""SELECT v.client_id, v.voucher_id, v.voucher_type, r.rv reversed_by, CASE WHEN r.rv IS NULL THEN 'posted' ELSE 'reversed' END effective_status
 FROM vouchers v LEFT JOIN (SELECT l_orderkey ok, l_suppkey sk, 'RV-SI-' || l_orderkey || '-' || l_suppkey rv FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey % 37 = 0 GROUP BY ALL) r
 ON v.voucher_id = substr(r.rv, 4)"""),
    "period_rollup": build(f"SELECT client_id, account_code, period, {money('d')} debit, {money('c')} credit FROM rollup_m"),
    "flux": build(f"SELECT client_id, account_code, period, {money('n')} net, {money('p')} previous, {money('n - p')} change FROM (SELECT *, lag(n) OVER (PARTITION BY client_id, account_code ORDER BY period) p FROM (SELECT *, d - c n FROM rollup_m)) WHERE p IS NOT NULL"),
    "chart_rollup": build(f"""SELECT client_id, g.code, g.name, g.root_type, {money('sum(amt)')} net FROM ledger JOIN chart c USING (account_code) JOIN chart_up u ON u.leaf = c.parent_code
 JOIN chart_groups g ON g.code = u.code WHERE posting_date <= DATE '{AS_OF}' GROUP BY 1, 2, 3, 4"""),
    "rollup_firm": build(f"SELECT firm_id, client_id, place_of_supply, {money('sum(grand_p)')} grand_total, count(*) documents FROM sales GROUP BY ROLLUP (firm_id, client_id, place_of_supply)"),
    "consolidated_tb": build(f"""SELECT firm_id, account_code, {money('sum(amt)')} net FROM doc_legs l WHERE posting_date <= DATE '{AS_OF}' AND NOT EXISTS (SELECT 1 FROM (SELECT ok || '-' || sk pair FROM line_docs WHERE seller_firm = buyer_firm) x
 WHERE x.pair = regexp_replace(l.voucher_id, '^(RV-)?[A-Z]{{2}}-', '')) GROUP BY 1, 2 HAVING sum(amt) <> 0"""),
    "control_totals": build(f"""SELECT client_id, n entries, {money('d')} sum_debit, {money('c')} sum_credit, {money('td')} tb_debit, {money('tc')} tb_credit, d = c self_balancing, d = td AND c = tc ties
 FROM (SELECT client_id, count(*) n, sum(greatest(amt, 0)) d, sum(greatest(-amt, 0)) c FROM ledger WHERE posting_date <= DATE '{AS_OF}' GROUP BY 1) JOIN
 (SELECT client_id, sum(d) td, sum(c) tc FROM rollup_m WHERE period <= strftime(DATE '{AS_OF}', '%Y-%m') GROUP BY 1) r USING (client_id)"""),
    "ageing": ag("open_invoices"), "payables_ageing": ag("open_bills"),
    "cash_flow": build(f"""SELECT client_id, {money('np')} net_profit, {money('rc')} receivables_change, {money('pc')} payables_change, {money('tc')} tax_change, {money('cc')} cash_change, np + rc + pc + tc = cc ties FROM (
 SELECT client_id, sum(CASE WHEN root_type IN ('income','expense') THEN -amt ELSE 0 END) np, sum(CASE WHEN account_type = 'receivable' THEN -amt ELSE 0 END) rc,
 sum(CASE WHEN account_type = 'payable' THEN -amt ELSE 0 END) pc, sum(CASE WHEN account_type IN ('tax_input','tax_output','tds_payable','tds_receivable') THEN -amt ELSE 0 END) tc,
 sum(CASE WHEN account_type IN ('cash','bank') THEN amt ELSE 0 END) cc FROM ledger JOIN chart USING (account_code) WHERE posting_date BETWEEN DATE '{FROM}' AND DATE '{TO}' AND NOT is_opening GROUP BY 1)"""),
    "post_invoices": build(f"SELECT client_id, voucher_id, voucher_type, posting_date, account_code, {dc()}, party_id FROM doc_legs WHERE voucher_type IN ('sales','credit_note')"),
    "post_bills": build(f"SELECT client_id, voucher_id, voucher_type, posting_date, account_code, {dc()}, party_id FROM doc_legs WHERE voucher_type IN ('purchase','debit_note')"),
    "post_supplier_payments": build(f"SELECT client_id, voucher_id, posting_date, account_code, {dc()}, settles_voucher_id FROM legs_payment WHERE amt <> 0"),
    "post_reversals": build(f"SELECT client_id, voucher_id, posting_date, account_code, {dc()} FROM legs_rev WHERE amt <> 0"),
    "post_opening": build(f"SELECT client_id, voucher_id, account_code, party_id, {dc()}, is_opening FROM legs_opening WHERE amt <> 0"),
    "post_year_close": build(f"""SELECT client_id, 'YC-' || client_id || '-' || fy voucher_id, make_date(fy + 1, 3, 31) posting_date, account_code, {dc('a')} FROM (
 SELECT client_id, fy, account_code, -sum(amt) a FROM ledger JOIN chart USING (account_code) WHERE root_type IN ('income','expense') AND NOT is_opening GROUP BY 1, 2, 3
 UNION ALL SELECT client_id, fy, 3030, sum(amt) FROM ledger JOIN chart USING (account_code) WHERE root_type IN ('income','expense') AND NOT is_opening GROUP BY 1, 2) WHERE a <> 0"""),
    "post_depreciation": build(f"""SELECT client_id, asset_id, fb finance_book_id, last_day(CAST(DATE '2024-04-01' + to_months(CAST(i - 1 AS INTEGER)) AS DATE)) posting_date,
 {money('CASE WHEN i = n THEN cost - (cost // n) * (n - 1) ELSE cost // n END')} amount FROM (SELECT *, unnest(range(1, n + 1)) i FROM (SELECT CAST(p_partkey % 25 AS INTEGER) client_id, p_partkey asset_id,
 CASE WHEN p_partkey % 2 = 1 THEN 'income_tax' END fb, CAST(round(p_retailprice * 100) AS BIGINT) cost, (p_partkey % 3 + 1) * 12 n FROM part))"""),
    "allocate_numbers": build("""SELECT client_id, f fy, voucher_id, n number, d document_number, length(d) <= 16 valid FROM (SELECT *, 'INV/' || substr(CAST(f AS VARCHAR), 3, 2) || '-' || lpad(CAST((f + 1) % 100 AS VARCHAR), 2, '0') || '/' ||
 CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END d FROM numbered)"""),
    "gstr1_doc_issue": build("""SELECT client_id, f fy, row_number() OVER (PARTITION BY client_id, f ORDER BY min(n)) range_no, min(n) from_number, max(n) to_number, count(*) issued FROM (
 SELECT client_id, f, n, n - row_number() OVER (PARTITION BY client_id, f ORDER BY n) isl FROM numbered WHERE n % 13 <> 0) GROUP BY client_id, f, isl"""),
    "against_accounts": build("""SELECT voucher_id, coalesce(string_agg(DISTINCT CAST(account_code AS VARCHAR), ',' ORDER BY CAST(account_code AS VARCHAR)) FILTER (amt > 0), '') debit_accounts,
 coalesce(string_agg(DISTINCT CAST(account_code AS VARCHAR), ',' ORDER BY CAST(account_code AS VARCHAR)) FILTER (amt < 0), '') credit_accounts FROM ledger GROUP BY 1"""),
    "validate_ledger": rules([
        ("V-1", "voucher_id", "(SELECT voucher_id, sum(amt) s FROM ledger WHERE NOT is_opening GROUP BY 1)", "s <> 0"),
        ("V-2", "voucher_id", "(SELECT voucher_id, count(*) s FROM ledger WHERE NOT is_opening GROUP BY 1)", "s < 2"),
        ("V-5", KEY, "ledger", "account_code IN (1030, 2010) AND party_id IS NULL"),
        ("V-6", "voucher_id", "vouchers v", "EXISTS (SELECT 1 FROM closed_m c WHERE c.client_id = v.client_id AND c.ps = date_trunc('month', v.posting_date))"),
        ("V-8", "client_id || '/' || voucher_type || '/' || f || '/' || voucher_number", f"(SELECT client_id, voucher_type, {fy('posting_date')} f, voucher_number, count(*) n FROM vouchers GROUP BY ALL)", "n > 1"),
        ("V-9", "voucher_id", "sales", "ok % 331 = 0"),
        ("V-13", "client_id || '/' || party_id || '/' || bill_number", "(SELECT client_id, party_id, grand_p, bill_date, bill_number, count(*) n FROM entered GROUP BY ALL)", "n > 1"),
        ("V-10", KEY, "ledger", "account_code = 5199 AND abs(amt) > 100"),
        ("V-12", "voucher_id", "vouchers", "created_via = 'ai_proposal' AND approved_by IS NULL")]),
    "validate_invoices": rules([
        ("SI-1", "voucher_id", "sales", f"{REG} AND {why('party_gstin')} IS NOT NULL"), ("SI-2", "voucher_id", "sales", f"{why('supplier_gstin')} IS NOT NULL"),
        ("SI-3", "voucher_id", "sales", f"{REG} AND party_gstin IS NULL"), ("SI-4", "voucher_id", "sales", f"place_of_supply NOT IN {OKS}"),
        ("SI-6", "voucher_id", "sales", "cgst_p > 0 AND igst_p > 0"), ("SI-11", "voucher_id", "sales", "gst_category = 'registered_composition' AND cgst_p + igst_p > 0"),
        ("SI-13", "voucher_id", "sales n", "is_return AND NOT EXISTS (SELECT 1 FROM sales o WHERE NOT o.is_return AND o.ok = n.ok AND o.sk = n.sk)"),
        ("SI-14", "voucher_id", "sales n", "is_return AND EXISTS (SELECT 1 FROM sales o WHERE NOT o.is_return AND o.ok = n.ok AND o.sk = n.sk AND n.grand_p > o.grand_p)")]),
    "validate_bills": rules([
        ("PB-1", "voucher_id", "bills", f"supplier_gstin IS NOT NULL AND {why('supplier_gstin')} IS NOT NULL"),
        ("PB-4", "voucher_id", "bills", "stated_cgst_p <> cgst_p OR stated_igst_p <> igst_p"), ("PB-6", "voucher_id", "bills", f"place_of_supply NOT IN {OKS}"),
        ("PB-7", "voucher_id", "bills", "itc_eligibility = 'mixed'"),
        ("PB-8", "voucher_id", "bills", "2 * claim_cgst_p + claim_igst_p > 0 AND voucher_id IN (SELECT voucher_id FROM recon_status)"),
        ("PB-12", "voucher_id", "bills", "created_via = 'ai_proposal' AND approved_by IS NULL")]),
    "validate_matches": rules([
        ("BV-5", "line_id", "(SELECT m.line_id, sum(amount_p) s, any_value(amt) a FROM matches m JOIN event_lines e USING (line_id) WHERE unmatched_on IS NULL GROUP BY 1)", "s > a"),
        ("BV-6", "match_id", "(SELECT match_id, m.client_id c1, e.client_id c2, unmatched_on FROM matches m JOIN event_lines e USING (line_id))", "unmatched_on IS NULL AND c1 <> c2"),
        ("BV-9", "match_id", "matches", "unmatched_on IS NULL AND ambiguous AND match_type <> 'manual'"),
        ("BV-11", "match_id", "matches", "unmatched_on IS NULL AND match_type = 'ai_proposed' AND approved_by IS NULL")]),
    "validate_dims": rules([
        ("DIM-GSTIN", "party_id", "parties", f"({REG}) = (gstin IS NULL)"), ("DIM-CHECK", "party_id", "parties", f"gstin IS NOT NULL AND {WHY} IS NOT NULL"),
        ("DIM-STATE", "party_id", "parties", "gstin IS NOT NULL AND substr(gstin, 1, 2) <> state_code"),
        ("DIM-UNIQUE", "nation || '/' || gstin", "(SELECT nation, gstin, count(*) n FROM parties WHERE gstin IS NOT NULL GROUP BY 1, 2)", "n > 1"),
        ("DIM-UNIQUE", "firm_id || '/' || gstin", "(SELECT firm_id, gstin, count(*) n FROM clients WHERE gstin IS NOT NULL GROUP BY 1, 2)", "n > 1"),
        ("DIM-GSTIN", "CAST(client_id AS VARCHAR)", "clients", "gstin IS NULL"), ("DIM-CHECK", "CAST(client_id AS VARCHAR)", "clients", f"gstin IS NOT NULL AND {WHY} IS NOT NULL"),
        ("DIM-STATE", "CAST(client_id AS VARCHAR)", "clients", "gstin IS NOT NULL AND substr(gstin, 1, 2) <> state_code"),
        ("DIM-EXPENSE", "CAST(account_code AS VARCHAR)", "chart", "(root_type = 'expense') <> (expense_class IS NOT NULL)"),
        ("DIM-LIQUIDITY", "CAST(account_code AS VARCHAR)", "chart", "(root_type IN ('asset', 'liability')) <> (liquidity_class IS NOT NULL)"),
        ("DIM-RANGE", "'gst_rate/' || rate_id", "gst_rates", "effective_to < effective_from"), ("DIM-RANGE", "'threshold/' || \"key\"", "thresholds", "effective_to < effective_from"),
        ("DIM-RANGE", "'tds_section/' || section_id", "tds_sections", "effective_to < effective_from")]),
    "vendor_account_prior": build("""SELECT client_id, party_id, expense_account, count(*) priors FROM (SELECT *, row_number() OVER (PARTITION BY client_id, party_id ORDER BY order_date DESC, ok DESC, sk DESC, expense_account) n FROM (
 SELECT DISTINCT ok, sk, expense_account, buyer client_id, order_date, 'S' || sk party_id FROM line_docs WHERE NOT is_return)) WHERE n <= 5 GROUP BY 1, 2, 3 HAVING count(*) >= 3"""),
    "duplicate_documents": "SELECT sha256(text) sha256, count(*) copies, min(doc_id) first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "duplicate_claims": build(f"SELECT txn_date, {money('debit_p')} debit, count(DISTINCT account_id) claimants, count(*) claims FROM event_lines WHERE debit_p > 0 GROUP BY txn_date, debit_p HAVING count(DISTINCT account_id) > 1"),
    "build_audit_chain": build("SELECT id, firm_id, segment, prev_hash, row_hash FROM sealed"),
    "chain_checkpoints": build("SELECT firm_id, segment, CAST(occurred_at AS DATE) \"day\", arg_max(row_hash, s.id) terminal_hash, max(s.id) last_id FROM sealed s JOIN (SELECT id, occurred_at FROM audit_rows) r ON r.id = s.id GROUP BY 1, 2, 3"),
    "verify_audit_chain": build("SELECT firm_id, segment, count(*) checked, min(CASE WHEN id IN (77, 503) THEN id END) broken_at, min(CASE WHEN id IN (77, 503) THEN id END) IS NULL ok FROM audit_rows GROUP BY 1, 2"),
    "audit_segment_chain": build('SELECT firm_id, segment, n "rows", last_id, digest, prev_link, link FROM segment_links'),
    "verify_audit_segments": build("""SELECT firm_id, count(*) segments, CASE firm_id WHEN 2 THEN 0 WHEN 3 THEN max(segment) END broken_at, firm_id NOT IN (2, 3) ok FROM (
 SELECT DISTINCT firm_id, segment FROM audit_rows) GROUP BY 1"""),
    "audit_by_entity": build("SELECT firm_id, entity_type, entity_id, count(*) changes, min(id) first_id, max(id) last_id FROM audit_rows GROUP BY 1, 2, 3"),
    "audit_by_actor": build("SELECT firm_id, client_id, actor_user_id, \"action\", count(*) changes FROM audit_rows GROUP BY 1, 2, 3, 4"),
    "support_access": build("SELECT id, firm_id, client_id, entity_type, entity_id, \"action\" FROM audit_rows WHERE actor_type = 'support'"),
    "backdated_entries": build("SELECT client_id, voucher_id, posting_date, entered_on, CAST(entered_on - posting_date AS INTEGER) AS days FROM vouchers WHERE entered_on - posting_date > 30"),
    "reversal_report": build("""SELECT client_id, voucher_id, posting_date, 'RV-' || voucher_id reversal_id, 'customer cancelled' reason, 'u' || (ok % 7) reversed_by, posting_date + 10 reversed_on
 FROM sales WHERE is_reversed"""),
    "origin_breakdown": build("SELECT client_id, voucher_type, count(*) vouchers, count(*) FILTER (created_via = 'ai_proposal') machine, count(*) FILTER (created_via = 'ai_proposal' AND ai_edited) machine_edited FROM vouchers GROUP BY 1, 2"),
    "period_status": build("SELECT client_id, strftime(occurred_at, '%Y-%m') period, arg_max(CASE WHEN \"action\" = 'approve' THEN 'closed' ELSE 'open' END, id) status, max(id) event_id FROM audit_rows WHERE \"action\" IN ('approve','reverse') GROUP BY 1, 2"),
    "account_versions": build("""SELECT entity_type, entity_id, id, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY id) "version", regexp_extract("after", '"k": *(\\d+)', 1) k FROM (
 SELECT *, lag("after") OVER (PARTITION BY entity_type, entity_id ORDER BY id) p FROM audit_rows) WHERE p IS NULL OR p <> "after\""""),
    "applied_rules": build("""SELECT voucher_id, hsn, 'gst_rate' rule_type, rate_id rule_row_id, '{"prefix":"' || hsn_prefix || '","id":' || rate_id || '}' rule_snapshot, citation FROM (SELECT DISTINCT voucher_id, hsn, posting_date FROM sales_lines) s
 JOIN gst_rates r ON starts_with(s.hsn, hsn_prefix) AND posting_date >= effective_from"""),
    "computation_traces": build(" UNION ALL ".join(f"SELECT voucher_id, pk, line_number, '{f}' output_field, '{e}' expression, {money('taxable_p')} taxable, CAST(slab AS DECIMAL(5,2)) gst_rate, {money(c)} result FROM sales_lines WHERE treatment = 'taxable' AND {c} > 0"
        for f, e, c in (("cgst_amount", "taxable_value × gst_rate ÷ 2", "cgst_p"), ("igst_amount", "taxable_value × gst_rate", "igst_p")))),
    "lineage_forward": build(f"SELECT l.client_id, account_code, l.voucher_id, bill_number, b.party_id supplier_id, n_lines, {dc()} FROM doc_legs l JOIN bills b USING (voucher_id) WHERE account_code IN (5010, 5020) AND fy = 2025"),
    "lineage_reverse": build(f"SELECT voucher_id, root_type, count(*) legs, {money('sum(amt)')} net FROM doc_legs JOIN chart USING (account_code) WHERE voucher_type = 'purchase' GROUP BY 1, 2"),
}
