"""Check queries for the bank jobs."""
from __future__ import annotations

from ..functions import text as t
from .base import build, cte, money, q

AS_OF = "DATE '2027-03-31'"
cte("event_lines", """
SELECT *, CASE WHEN event_type IN ('purchase','signup') THEN 0 ELSE amt END debit_p, CASE WHEN event_type IN ('purchase','signup') THEN amt ELSE 0 END credit_p
FROM (SELECT CAST(user_id % 25 AS INTEGER) client_id, user_id account_id, 'E' || event_id line_id, event_id line_key, CAST(ts AS DATE) txn_date,
  event_type, CAST(round(value * 100) AS BIGINT) amt, event_id % 101 = 0 is_ignored, 'statement' src,
  CASE event_id % 11 WHEN 0 THEN 'UPI/' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '/Payment from/user' || user_id || '@okbank/UPI'
   WHEN 1 THEN 'UPI-XXXXXXX7140-SBIN0000641-' || lpad(CAST(event_id AS VARCHAR), 12, '0')
   WHEN 2 THEN 'NEFT-UTIB' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '-Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0')
   WHEN 3 THEN 'RTGS-HDFCR' || lpad(CAST(event_id AS VARCHAR), 11, '0') || '-Supplier#' || lpad(CAST(user_id AS VARCHAR), 9, '0')
   WHEN 4 THEN 'IMPS/P2A/' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '/RAMESH KUMAR/HDFC'
   WHEN 5 THEN 'CHQ PAID 0' || lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0')
   WHEN 6 THEN 'ACH C- EXAMPLE COMPANY-' || lpad(CAST(event_id AS VARCHAR), 8, '0')
   WHEN 7 THEN 'ATM WDL ' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || '  MAIN  ROAD'
   WHEN 8 THEN 'BY CASH DEPOSIT' WHEN 9 THEN 'INT.PD:01-04-2026 TO 30-06-2026'
   ELSE CASE WHEN event_id % 22 = 10 THEN 'SMS CHARGES QTR' ELSE 'MISC ADJ ' || event_id END END narration FROM events)""")
cte("collection_lines", """
SELECT *, 0 debit_p FROM (SELECT client_id, CAST(client_id AS BIGINT) account_id, 'K' || ok || '-' || sk line_id, ok line_key,
  posting_date + CAST(ok % 40 + 1 AS INTEGER) txn_date, 'NEFT-REFN' || lpad(CAST(ok AS VARCHAR), 12, '0') || '-' || party_name narration,
  CASE WHEN ok % 8 = 2 THEN 'collection' ELSE 'statement' END src, false is_ignored,
  CASE WHEN ok % 5 = 0 THEN grand_p // 2 WHEN ok % 3 = 0 THEN grand_p - (taxable_p * 10 + 50) // 100 ELSE grand_p END credit_p
FROM sales WHERE NOT is_return AND NOT is_reversed AND status = 'O' AND ok % 4 IN (1, 2)) WHERE credit_p > 0""")
cte("outflow_lines", """
SELECT client_id, CAST(client_id AS BIGINT) account_id, 'P' || ok || '-' || sk line_id, ok line_key, bill_date + CAST(ok % 40 AS INTEGER) txn_date,
  'RTGS-SBINR' || lpad(CAST(ok AS VARCHAR), 12, '0') || '-' || party_name narration, 'statement' src, false is_ignored, grand_p debit_p, 0 credit_p
FROM bills WHERE NOT is_return AND status = 'O' AND ok % 4 = 3 AND grand_p > 0""")
LC = "client_id, account_id, line_id, line_key, txn_date, narration, src, is_ignored, debit_p, credit_p"
cte("doc_bank_lines", f"SELECT {LC} FROM collection_lines UNION ALL SELECT {LC} FROM outflow_lines")
cte("bank_lines", f"SELECT {LC} FROM event_lines UNION ALL SELECT {LC} FROM doc_bank_lines")


def tidy(x: str) -> str:
    s = rf"trim(regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^[\s\-/:.]+|[\s\-/:.]+$', '', 'g'))"
    return f"CASE WHEN length({s}) > 1 THEN {s} END"


def parsed(src: str) -> str:
    rule = "CASE " + " ".join(f"WHEN regexp_matches(trim(narration), {q(p)}) THEN '{n}'" for n, _, p, _, _ in t.NARRATION_RULES) + " END"
    mode = "CASE rule " + " ".join(f"WHEN '{n}' THEN '{m}'" for n, m, *_ in t.NARRATION_RULES) + " END"

    def part(i: int) -> str:
        arms = [(r[0], r[2], r[i]) for r in t.NARRATION_RULES if r[i]]
        return "CASE rule " + " ".join(
            f"WHEN '{n}' THEN {tidy(f'regexp_extract(trim(narration), {q(p)}, {g})')}" for n, p, g in arms) + " END"
    utr = (f"list_filter(regexp_extract_all(trim(narration), {q(t.UTR)}, 1), lambda x: NOT regexp_matches(upper(x), {q(t.IFSC)}))[1]")
    return (f"SELECT *, CASE WHEN payment_mode = 'upi' THEN coalesce(pos_ref, utr) ELSE coalesce(utr, pos_ref) END reference FROM ("
            f"SELECT *, {mode} payment_mode, {part(3)} pos_ref, {part(4)} counterparty, {utr} utr FROM (SELECT *, {rule} \"rule\" FROM {src}))")


cte("parsed_all", parsed("bank_lines"))
cte("parsed_events", parsed("event_lines"))
cte("open_lines", f"SELECT {LC} FROM line_status_now WHERE status = 'unmatched'")
cte("parsed_docs", parsed("open_lines"))
cte("parsed_coll", parsed("collection_lines"))
cte("stated_lines", """
SELECT *, CASE WHEN line_key % 13 = 0 THEN NULL WHEN line_key % 997 = 0 THEN true_p + 50 ELSE true_p END stated_p
FROM (SELECT *, CAST((txn_date - DATE '2024-01-01') // 7 AS INTEGER) AS week,
  CAST(100000 + sum(credit_p - debit_p) OVER (PARTITION BY account_id ORDER BY txn_date, line_key) AS BIGINT) true_p FROM event_lines)""")
cte("statements", """
SELECT client_id, account_id, week, min(txn_date) period_from, max(txn_date) period_to, count(*) row_count,
  arg_min(true_p - credit_p + debit_p, line_key) open_p,
  arg_max(true_p, line_key) + CASE WHEN (account_id + week) % 50 = 0 THEN 1000 ELSE 0 END close_p FROM stated_lines GROUP BY client_id, account_id, week""")
cte("statement_rows", """
SELECT r.*, coalesce(anchor_p, open_p) + net_p expected_p FROM (
SELECT *, last_value(stated_p - net_p IGNORE NULLS) OVER (PARTITION BY account_id, week ORDER BY txn_date, line_key
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) anchor_p FROM (
SELECT *, CAST(sum(credit_p - debit_p) OVER (PARTITION BY account_id, week ORDER BY txn_date, line_key) AS BIGINT) net_p FROM stated_lines)) r
JOIN statements USING (account_id, week)""")
cte("matches", """
SELECT 'M' || line_key match_id, line_id, account_id,
  CASE WHEN line_key % 47 = 0 THEN (client_id + 1) % 25 ELSE client_id END client_id,
  CASE WHEN line_key % 9 = 6 THEN amt // 2 WHEN line_key % 41 = 0 THEN amt + 10000 ELSE amt END amount_p,
  CASE WHEN line_key % 2 = 0 THEN 'ai_proposed' WHEN line_key % 5 = 0 THEN 'scored' ELSE 'manual' END match_type,
  CASE WHEN line_key % 30 = 0 THEN NULL ELSE 'u' || (line_key % 7) END approved_by, line_key % 60 = 3 ambiguous,
  txn_date created_on, CASE WHEN line_key % 27 = 0 THEN txn_date + 5 END unmatched_on FROM event_lines WHERE line_key % 3 = 0""")
cte("cheques", """
SELECT *, lpad(CAST(ok % 1000000 AS VARCHAR), 6, '0') cheque_number, CAST(client_id AS BIGINT) account_id,
  CASE ok % 4 WHEN 1 THEN 'cleared' WHEN 2 THEN 'bounced' ELSE 'pending' END status,
  CASE WHEN ok % 4 = 1 THEN cheque_date + CAST(ok % 20 AS INTEGER) END cleared_date,
  CASE WHEN ok % 4 = 2 THEN cheque_date + CAST(ok % 10 + 3 AS INTEGER) END bounced_date FROM (
SELECT client_id, voucher_id, ok, 'received' direction, receipt_date cheque_date, cash_p amount_p FROM receipts WHERE ok % 9 = 0
UNION ALL SELECT client_id, voucher_id, ok, 'issued', payment_date, amount_p FROM payments WHERE ok % 9 = 1)""")


def status(src: str, live: str) -> str:
    return f"""SELECT l.*, coalesce(m_p, 0) matched_p, debit_p + credit_p - coalesce(m_p, 0) open_p,
  CASE WHEN is_ignored THEN 'ignored' WHEN coalesce(m_p, 0) = 0 THEN 'unmatched' WHEN m_p >= debit_p + credit_p THEN 'matched'
  ELSE 'partially_matched' END status FROM {src} l LEFT JOIN (SELECT line_id, CAST(sum(amount_p) AS BIGINT) m_p FROM matches
  WHERE {live} GROUP BY 1) USING (line_id)"""


cte("line_status_now", status("bank_lines", "unmatched_on IS NULL"))
B = "DATE '2025-03-31'"
cte("line_status_then", status("bank_lines", f"created_on <= {B} AND (unmatched_on IS NULL OR unmatched_on > {B})"))
cte("open_invoices", """
SELECT s.client_id, s.voucher_id, s.party_id, s.party_name, posting_date document_date, s.taxable_p, s.grand_p, s.grand_p - coalesce(p, 0) due, expected_reference reference
FROM sales s LEFT JOIN (SELECT settles_voucher_id v, CAST(sum(cash_p + tds_p) AS BIGINT) p FROM receipts GROUP BY 1) r ON r.v = s.voucher_id
WHERE NOT is_return AND NOT is_reversed AND s.grand_p - coalesce(p, 0) > 0""")
cte("open_bills", """
SELECT b.client_id, b.voucher_id, bill_number document_number, b.party_id, b.party_name, bill_date document_date, b.grand_p, b.grand_p - coalesce(p, 0) due
FROM bills b LEFT JOIN (SELECT settles_voucher_id v, CAST(sum(amount_p) AS BIGINT) p FROM payments GROUP BY 1) r ON r.v = b.voucher_id
WHERE NOT is_return AND b.grand_p - coalesce(p, 0) > 0""")
cte("client_parties", "SELECT DISTINCT client_id, party_id, party_name FROM (SELECT client_id, party_id, party_name FROM sales UNION ALL SELECT client_id, party_id, party_name FROM bills)")
cte("resolved_party", """
SELECT n.client_id, n.counterparty, min(p.party_id) party_id FROM (SELECT DISTINCT client_id, counterparty FROM parsed_docs WHERE length(counterparty) > 1) n
JOIN client_parties p ON p.client_id = n.client_id AND (contains(lower(n.counterparty), lower(party_name)) OR contains(lower(party_name), lower(n.counterparty)))
GROUP BY ALL""")
cte("ranked", """
SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY score DESC, document_date, voucher_id) rnk FROM (
SELECT *, CASE WHEN by_ref THEN 50 ELSE 0 END + CASE WHEN eq THEN 30 WHEN tol THEN 15 ELSE 0 END + CASE WHEN by_party THEN 15 ELSE 0 END
  + CASE WHEN days <= 3 THEN 5 WHEN days <= 30 THEN 2 ELSE 0 END score,
  concat_ws('+', CASE WHEN by_ref THEN 'reference' END, CASE WHEN eq THEN 'amount' WHEN tol THEN 'tolerance' END, CASE WHEN by_party THEN 'party' END,
   CASE WHEN days <= 3 THEN '3d' WHEN days <= 30 THEN '30d' END) signals FROM (
SELECT line_id, voucher_id, document_date, coalesce(upper(l.reference) = upper(d.reference), false) by_ref, amt = due eq,
  abs(due - amt) <= 10000 OR abs(due - amt) * 100 <= due * 12 tol, coalesce(l.party_id = d.party_id, false) by_party,
  abs(txn_date - document_date) AS days
FROM (SELECT p.*, debit_p + credit_p amt, credit_p > 0 inbound, r.party_id FROM parsed_docs p LEFT JOIN resolved_party r USING (client_id, counterparty)) l
JOIN (SELECT client_id, true inbound, voucher_id, party_id, document_date, due, reference FROM open_invoices
  UNION ALL SELECT client_id, false, voucher_id, party_id, document_date, due, NULL FROM open_bills) d
  ON d.client_id = l.client_id AND d.inbound = l.inbound)) WHERE score >= 15""")
cte("proposals", """
SELECT *, CASE WHEN by_ref THEN 'exact_reference' ELSE 'scored' END layer, score >= 45 AND NOT ambiguous auto_matchable FROM (
SELECT *, coalesce(score - second_score < 15 AND second_score >= 30, false) ambiguous FROM (
SELECT line_id, max(CASE WHEN rnk = 1 THEN voucher_id END) voucher_id, max(CASE WHEN rnk = 1 THEN score END) score,
  max(CASE WHEN rnk = 1 THEN signals END) signals, bool_or(rnk = 1 AND by_ref) by_ref, max(CASE WHEN rnk = 2 THEN score END) second_score,
  count(*) - 1 runners_up FROM ranked WHERE rnk <= 4 GROUP BY 1))""")
RULES = """(SELECT client_id, client_id * 100 + p rule_id, p FROM clients, (VALUES (10), (20), (25), (30), (40), (50), (60)) v(p) WHERE client_id % 3 <> 2)"""
cte("rule_hits", f"""
SELECT client_id, line_id, arg_min(rule_id, p) rule_id, min(p) p FROM (SELECT e.*, r.rule_id, r.p FROM parsed_all e JOIN {RULES} r USING (client_id)
 WHERE (p = 10 AND starts_with(upper(narration), 'SMS CHARGES') AND payment_mode = 'charge' AND debit_p > 0)
  OR (p = 20 AND contains(upper(narration), 'INT.PD') AND payment_mode = 'interest' AND debit_p = 0)
  OR (p = 25 AND regexp_matches(upper(narration), 'ATM WDL [0-9]{{3}}[02468] +MAIN') AND debit_p + credit_p >= 2000)
  OR (p = 30 AND starts_with(upper(narration), 'ATM') AND debit_p + credit_p <= 20000)
  OR (p = 40 AND contains(upper(narration), 'EXAMPLE COMPANY') AND debit_p + credit_p >= 5000)
  OR (p = 50 AND regexp_matches(upper(narration), '^NEFT-REFN0+[0-9]*7-(CUSTOMER|SUPPLIER)#') AND debit_p = 0)
  OR (p = 60 AND payment_mode = 'cheque' AND debit_p > 0 AND debit_p + credit_p >= 10000)) GROUP BY ALL""")


def canon(p: str) -> str:
    return f"CAST({money(p)} AS VARCHAR)"


def hash_sql(bal: str) -> str:
    return (f"sha256(concat_ws('|', account_id, txn_date, {canon('debit_p')}, {canon('credit_p')}, trim(regexp_replace(narration, '\\s+', ' ', 'g')), {bal}))")


def line_legs(src: str, prefix: str, rows: list[tuple[int, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT client_id, '{prefix}' || line_id voucher_id, txn_date posting_date, CAST({a} AS INTEGER) account_code, "
        f"{money(f'greatest({x}, 0)')} debit, {money(f'greatest(-({x}), 0)')} credit FROM {src} WHERE {x} <> 0" for a, x in rows)


cte("charge_src", "SELECT *, (debit_p * 18 + 59) // 118 gst, client_id % 2 = 0 intra FROM parsed_events WHERE payment_mode = 'charge' AND debit_p > 0")
cte("interest_src", "SELECT *, (credit_p * 10 + 4) // 9 gross FROM parsed_events WHERE payment_mode = 'interest' AND credit_p > 0")
cte("settle_src", """
SELECT * FROM (SELECT l.*, p.voucher_id inv, o.party_id, o.due, sum(credit_p) OVER (PARTITION BY p.voucher_id ORDER BY txn_date, line_id) upto
FROM proposals p JOIN bank_lines l USING (line_id) JOIN open_invoices o ON o.voucher_id = p.voucher_id WHERE auto_matchable AND credit_p > 0) WHERE upto <= due""")
cte("alloc_r", "SELECT client_id, party_id, voucher_id rid, cash_p p, CAST(sum(cash_p) OVER (PARTITION BY client_id, party_id ORDER BY receipt_date, ok, sk) AS BIGINT) hi FROM receipts WHERE cash_p > 0")
cte("alloc_d", "SELECT client_id, party_id, voucher_id did, grand_p p, CAST(sum(grand_p) OVER (PARTITION BY client_id, party_id ORDER BY posting_date, ok, sk) AS BIGINT) hi FROM sales WHERE NOT is_return AND NOT is_reversed AND grand_p > 0")
cte("bounced_legs", "SELECT * FROM legs_receipt UNION ALL SELECT * FROM legs_payment")
cte("account_credits", """
SELECT client_id, account_id, 'B' || client_id || '-' || n line_id, d + 1 + CAST((client_id + n) % 2 AS INTEGER) txn_date, s - CASE WHEN (client_id + n) % 7 = 0 THEN 100 ELSE 0 END credit_p FROM (
 SELECT client_id, account_id, (txn_date - DATE '2000-01-01') // (1 + client_id % 3) n, CAST(sum(credit_p) AS BIGINT) s, max(txn_date) d FROM collection_lines WHERE src = 'collection' GROUP BY 1, 2, 3)
WHERE (client_id + n) % 11 <> 0 UNION ALL SELECT client_id, account_id, line_id, txn_date, credit_p FROM collection_lines WHERE src = 'statement'""")
# every range of days is summed by itself
cte("day_ranges", """
SELECT a.client_id, a.account_id, a.txn_date from_day, b.txn_date to_day, CAST(sum(c.tot) AS BIGINT) tot FROM batches a JOIN batches b ON a.client_id = b.client_id AND a.account_id = b.account_id
 AND b.txn_date >= a.txn_date AND b.txn_date - a.txn_date < 7 JOIN batches c ON c.client_id = a.client_id AND c.account_id = a.account_id AND c.txn_date BETWEEN a.txn_date AND b.txn_date GROUP BY 1, 2, 3, 4""")
cte("settled_ranges", """
SELECT client_id, account_id, line_id, txn_date settled_on, arg_max(from_day, to_day) from_day, max(to_day) to_day FROM account_credits c JOIN day_ranges r USING (client_id, account_id)
WHERE r.tot = c.credit_p AND c.txn_date - r.to_day BETWEEN 0 AND 3 GROUP BY 1, 2, 3, 4""")
cte("batches", "SELECT client_id, account_id, txn_date, CAST(sum(credit_p) AS BIGINT) tot, count(*) collections FROM collection_lines WHERE src = 'collection' GROUP BY ALL")

cte("hashed_events", f"""SELECT *, {hash_sql("''")} content_hash FROM bank_lines""")
SQL = {
    "parse_narration": build('SELECT line_id, "rule", payment_mode, reference, counterparty FROM parsed_all'),
    "narration_residue": build('SELECT line_id, narration, reference FROM parsed_all WHERE "rule" IS NULL'),
    "line_hint": build("""SELECT line_id, hint FROM (SELECT line_id, CASE WHEN payment_mode = 'charge' THEN 'bank_charge'
 WHEN payment_mode = 'interest' THEN CASE WHEN credit_p > 0 THEN 'interest' ELSE 'bank_charge' END WHEN payment_mode = 'cheque' THEN 'cheque' END hint
 FROM parsed_all) WHERE hint IS NOT NULL"""),
    "line_hash": build(f"SELECT line_id, {hash_sql('coalesce(' + canon('stated_p') + ', chr(0))')} content_hash FROM stated_lines").replace("chr(0)", "''"),
    "account_hash": build("SELECT account_id, sha256('AC' || lpad(CAST(account_id AS VARCHAR), 12, '0')) account_hash, right(lpad(CAST(account_id AS VARCHAR), 12, '0'), 4) last4 FROM (SELECT DISTINCT account_id FROM bank_lines)"),
    "append_new_lines": build("""SELECT account_id, content_hash, min((txn_date, line_key, line_id))[3] line_id, count(*) copies FROM hashed_events GROUP BY 1, 2
HAVING min(txn_date) > DATE '2024-01-10'"""),
    "bank_line_status": build(f"SELECT line_id, {money('debit_p + credit_p')} amount, {money('matched_p')} matched_amount, {money('open_p')} unmatched_amount, status FROM line_status_now"),
    "match_summary": build("""SELECT account_id, count(*) FILTER (status = 'unmatched') unmatched, count(*) FILTER (status = 'matched') matched,
 count(*) FILTER (status = 'partially_matched') partially_matched, count(*) FILTER (status = 'ignored') ignored,
 count(*) FILTER (auto_matchable) auto_matchable, count(*) FILTER (ambiguous) ambiguous FROM line_status_now LEFT JOIN (SELECT line_id, auto_matchable, ambiguous FROM proposals) USING (line_id) GROUP BY 1"""),
    "statement_bad_rows": build(f"""SELECT client_id, account_id, week, line_id, txn_date, {money('debit_p')} debit, {money('credit_p')} credit,
 {money('stated_p')} running_balance, {money('expected_p')} expected_balance FROM statement_rows WHERE stated_p IS NOT NULL AND stated_p <> expected_p"""),
    "statement_arithmetic": build(f"""SELECT account_id, week, {money('open_p')} opening_balance, {money('d')} total_debits, {money('c')} total_credits,
 {money('open_p + c - d')} computed_closing, {money('close_p')} declared_closing, {money('close_p - open_p - c + d')} difference, bad_rows, first_bad_line,
 close_p - open_p - c + d = 0 AND bad_rows = 0 ok FROM (SELECT account_id, week, sum(debit_p) d, sum(credit_p) c,
 count(*) FILTER (stated_p <> expected_p) bad_rows, arg_min(line_id, line_key) FILTER (stated_p <> expected_p) first_bad_line
 FROM statement_rows GROUP BY 1, 2) JOIN statements USING (account_id, week)"""),
    "statement_gaps": build(f"""SELECT account_id, week, period_from, {money('open_p')} opening_balance, previous_to, {money('pc')} previous_closing,
 CAST(period_from - previous_to - 1 AS INTEGER) gap_days, period_from - previous_to - 1 = 0 AND pc <> open_p discontinuous FROM (SELECT *,
 lag(period_to) OVER w previous_to, lag(close_p) OVER w pc FROM statements WINDOW w AS (PARTITION BY account_id ORDER BY period_from, week))
 WHERE previous_to < period_from AND (period_from - previous_to > 1 OR pc <> open_p)"""),
    "bank_reconciliation": build(f"""SELECT account_id, {money('book')} book_balance, {money('unp')} unpresented, {money('unc')} uncredited,
 {money('bd')} bank_debits, {money('bc')} bank_credits, unp_n unpresented_count, unc_n uncredited_count, bd_n bank_debit_count, bc_n bank_credit_count,
 {money('actual')} actual_balance, {money('book + unp - unc - bd + bc')} computed_balance, {money('actual - (book + unp - unc - bd + bc)')} difference,
 actual = book + unp - unc - bd + bc ties FROM (
SELECT account_id, coalesce(book, 0) book, coalesce(unp, 0) unp, coalesce(unc, 0) unc, coalesce(bd, 0) bd, coalesce(bc, 0) bc,
 coalesce(unp_n, 0) unp_n, coalesce(unc_n, 0) unc_n, coalesce(bd_n, 0) bd_n, coalesce(bc_n, 0) bc_n, coalesce(cl, rn, 100000) actual
FROM (SELECT DISTINCT account_id FROM bank_lines)
LEFT JOIN (SELECT CAST(client_id AS BIGINT) account_id, sum(amt) book FROM ledger WHERE account_code = 1020 AND posting_date <= {B} GROUP BY 1) USING (account_id)
LEFT JOIN (SELECT account_id, sum(amount_p) FILTER (direction = 'issued') unp, sum(amount_p) FILTER (direction = 'received') unc,
  count(*) FILTER (direction = 'issued') unp_n, count(*) FILTER (direction = 'received') unc_n FROM cheques
  WHERE cheque_date <= {B} AND coalesce(cleared_date, bounced_date, DATE '9999-01-01') > {B} GROUP BY 1) USING (account_id)
LEFT JOIN (SELECT account_id, sum(open_p) FILTER (debit_p > 0) bd, sum(open_p) FILTER (credit_p > 0) bc, count(*) FILTER (debit_p > 0) bd_n,
  count(*) FILTER (credit_p > 0) bc_n FROM line_status_then WHERE txn_date <= {B} AND status <> 'matched' AND NOT is_ignored GROUP BY 1) USING (account_id)
LEFT JOIN (SELECT account_id, arg_max(close_p, week) cl FROM statements WHERE period_to <= {B} GROUP BY 1) USING (account_id)
LEFT JOIN (SELECT account_id, arg_max(stated_p, line_key) FILTER (stated_p IS NOT NULL) rn FROM stated_lines WHERE txn_date <= {B} GROUP BY 1) USING (account_id))"""),
    "unpresented_cheques": build(f"SELECT account_id, cheque_number, cheque_date, {money('amount_p')} amount, voucher_id FROM cheques WHERE direction = 'issued' AND cheque_date <= {B} AND (cleared_date IS NULL OR cleared_date > {B}) AND (bounced_date IS NULL OR bounced_date > {B})"),
    "cash_register": build(f"""SELECT client_id, account_code, posting_date date, {money('bal')} balance, {money('-bal')} shortfall FROM (
SELECT *, lag(bal, 1, 0) OVER (PARTITION BY client_id, account_code ORDER BY posting_date) prev FROM (SELECT * FROM (
SELECT client_id, account_code, posting_date, sum(sum(amt)) OVER (PARTITION BY client_id, account_code ORDER BY posting_date) bal
FROM ledger WHERE account_code = 1010 AND posting_date <= DATE '2026-03-31' GROUP BY 1, 2, 3) WHERE posting_date >= DATE '2024-01-01'))
WHERE bal < 0 AND prev >= 0"""),
    "stale_cheques": build(f"SELECT client_id, cheque_number, voucher_id, cheque_date, direction, {money('amount_p')} amount, CAST({AS_OF} - cheque_date AS INTEGER) age_days FROM cheques WHERE status = 'pending' AND {AS_OF} - cheque_date > 90"),
    "cheque_events": build(f"""SELECT client_id, voucher_id, cheque_number, direction, {money('amount_p')} amount, status, CAST(cleared_date - cheque_date AS INTEGER) float_days,
 CASE WHEN status = 'bounced' THEN 'RV-' || voucher_id END reversal_id, coalesce(cleared_date, bounced_date) event_date,
 status = 'bounced' AND direction = 'received' section_138 FROM cheques WHERE status <> 'pending'"""),
    "post_bounces": build(f"""SELECT l.client_id, 'RV-' || l.voucher_id voucher_id, bounced_date posting_date, account_code, {money('greatest(-amt, 0)')} debit, {money('greatest(amt, 0)')} credit, party_id
 FROM bounced_legs l JOIN cheques c ON c.voucher_id = l.voucher_id WHERE status = 'bounced' AND amt <> 0"""),
    "post_bank_charges": build(line_legs("charge_src", "CH-", [(5180, "debit_p - gst"), (1041, "CASE WHEN intra THEN gst // 2 ELSE 0 END"),
                                                               (1042, "CASE WHEN intra THEN gst - gst // 2 ELSE 0 END"), (1043, "CASE WHEN intra THEN 0 ELSE gst END"), (1020, "-debit_p")])),
    "post_interest": build(line_legs("interest_src", "IN-", [(1020, "credit_p"), (1050, "gross - credit_p"), (4110, "-gross")])),
    "apply_bank_rules": build("SELECT client_id, line_id, rule_id, CASE WHEN p IN (40, 50) THEN 'match_party' ELSE 'classify_as' END action, CAST(CASE p WHEN 10 THEN 5180 WHEN 20 THEN 4110 WHEN 25 THEN 1010 WHEN 30 THEN 1010 WHEN 60 THEN 2010 END AS INTEGER) target_account FROM rule_hits"),
    "rule_confirmations": build("SELECT client_id, rule_id, count(*) confirmed_count FROM rule_hits GROUP BY 1, 2 HAVING count(*) >= 3"),
    "open_invoices": build(f"SELECT client_id, voucher_id, party_id, document_date, {money('taxable_p')} taxable, {money('grand_p')} grand_total, {money('due')} outstanding, reference FROM open_invoices"),
    "open_bills": build(f"SELECT client_id, voucher_id, document_number, party_id, document_date, {money('grand_p')} grand_total, {money('due')} outstanding FROM open_bills"),
    "tds_shortfall": build(f"""SELECT voucher_id, {money('sf')} shortfall, CAST(CASE i WHEN 1 THEN 0.1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 5 WHEN 5 THEN 10 END AS DECIMAL(6,3)) implied_rate,
 CASE i WHEN 1 THEN 'purchase of goods' WHEN 2 THEN 'contractor — individual/HUF' WHEN 3 THEN 'contractor — company' WHEN 4 THEN 'commission or brokerage'
  WHEN 5 THEN 'professional or technical fees / rent' END section FROM (
SELECT *, CASE WHEN abs((taxable_p * 10 + 5000) // 10000 - sf) <= 100 THEN 1 WHEN abs((taxable_p * 100 + 5000) // 10000 - sf) <= 100 THEN 2
 WHEN abs((taxable_p * 200 + 5000) // 10000 - sf) <= 100 THEN 3 WHEN abs((taxable_p * 500 + 5000) // 10000 - sf) <= 100 THEN 4
 WHEN abs((taxable_p * 1000 + 5000) // 10000 - sf) <= 100 THEN 5 END i FROM (SELECT *, grand_p - cash_p sf FROM receipts)) WHERE sf > 0"""),
    "resolve_party": build("SELECT client_id, counterparty, party_id FROM resolved_party"),
    "match_known_link": build(f"""SELECT line_id, reference, voucher_id, {money('credit_p')} amount FROM parsed_coll JOIN (SELECT client_id, reference, arg_min(voucher_id, (document_date, voucher_id)) voucher_id
 FROM open_invoices WHERE reference IS NOT NULL GROUP BY 1, 2) USING (client_id, reference) WHERE src = 'collection'"""),
    "match_candidates": build('SELECT line_id, CAST(rnk AS INTEGER) "rank", voucher_id, score, signals FROM ranked WHERE rnk <= 4'),
    "match_proposals": build("SELECT line_id, voucher_id, score, signals, second_score, runners_up, layer, ambiguous, auto_matchable FROM proposals"),
    "match_queue": build("""SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY score DESC, txn_date DESC, line_id)::INT AS position FROM (
 SELECT account_id, line_id, txn_date, voucher_id, coalesce(score, -1) score FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY txn_date DESC, line_id) n FROM open_lines)
 LEFT JOIN (SELECT line_id, voucher_id, score FROM proposals) USING (line_id) WHERE n <= 500)"""),
    "post_receipts": build(f"""SELECT client_id, 'RX-' || line_id voucher_id, txn_date posting_date, CAST(a AS INTEGER) account_code,
 CASE WHEN a = 1020 THEN {money('credit_p')} ELSE {money('0')} END debit, CASE WHEN a = 1030 THEN {money('credit_p')} ELSE {money('0')} END credit,
 CASE WHEN a = 1030 THEN inv END settles_voucher_id FROM settle_src, (VALUES (1020), (1030)) v(a)"""),
    "allocate_receipts": build(f"""SELECT r.client_id, r.party_id, rid receipt_id, did voucher_id, {money('least(r.hi, d.hi) - greatest(r.hi - r.p, d.hi - d.p)')} amount
 FROM alloc_r r JOIN alloc_d d ON r.client_id = d.client_id AND r.party_id = d.party_id AND least(r.hi, d.hi) > greatest(r.hi - r.p, d.hi - d.p)"""),
    "settlement_batches": build(f"""SELECT b.client_id, b.account_id, b.txn_date, {money('b.tot')} batch_total, b.collections, c.best[1] settled_on, c.best[2] line_id, c.best IS NOT NULL double_counted
 FROM batches b LEFT JOIN (SELECT b.client_id, b.account_id, b.txn_date, min((r.settled_on, r.line_id)) best FROM batches b JOIN settled_ranges r
  ON r.client_id = b.client_id AND r.account_id = b.account_id AND b.txn_date BETWEEN r.from_day AND r.to_day GROUP BY 1, 2, 3) c USING (client_id, account_id, txn_date)"""),
}


def _close_readiness() -> str:
    """The reconciliation's own check query as of the month's end, next to the period events."""
    brs = SQL["bank_reconciliation"].replace("2025-03-31", "2024-01-31")
    return f"""SELECT c.client_id, '2024-01' AS period, b.n IS NULL AS ready, CAST(coalesce(b.n, 0) AS INTEGER) n_blockers, coalesce(b.t, '') blockers
FROM ({build("SELECT client_id FROM clients")}) c LEFT JOIN (SELECT client_id, count(*) n, string_agg(blocker, ',' ORDER BY blocker) t FROM (
 SELECT a.client_id, 'bank:' || lpad(CAST(a.account_id AS VARCHAR), 12, '0') blocker FROM ({build("SELECT DISTINCT client_id, account_id FROM bank_lines WHERE client_id % 6 <> 1")}) a
  JOIN ({brs}) r ON r.account_id = a.account_id WHERE NOT r.ties
 UNION ALL SELECT CAST(user_id % 25 AS INTEGER), 'closed' FROM events WHERE event_id % 4 IN (2, 3) AND strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1 HAVING arg_max(event_id % 4, event_id) = 2)
 GROUP BY 1) b USING (client_id)"""


SQL["close_readiness"] = _close_readiness()
