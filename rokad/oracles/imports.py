"""Check queries for the imports: what was written as files must be read back, faults included."""
from __future__ import annotations

from ..functions import gstin as g
from .base import build, cte, money, q
from .tax import WHY

cte("csv_lines", f"""
SELECT *, CASE WHEN doc_key % 97 = 0 THEN 'date' WHEN doc_key % 103 = 2 AND amt > 0 THEN 'amount' WHEN doc_key % 107 = 3 AND amt > 0 THEN 'one_sided'
  WHEN gstin IS NOT NULL AND {WHY} IS NOT NULL THEN 'gstin' WHEN NOT regexp_matches(pan, {q(g.PAN_LAYOUT)}) THEN 'pan' ELSE '' END problem,
  CASE WHEN doc_key % 103 = 2 AND amt > 0 THEN NULL ELSE greatest(amt, 0) END debit_p, CASE WHEN doc_key % 107 = 3 AND amt > 0 THEN amt ELSE greatest(-amt, 0) END credit_p
FROM (SELECT l.*, account_name, CASE WHEN doc_key % 109 = 4 THEN p.gstin || 'X' ELSE p.gstin END gstin,
  CASE WHEN doc_key % 113 = 5 THEN lower(substr(p.gstin, 3, 10)) ELSE substr(p.gstin, 3, 10) END pan
  FROM ledger l JOIN chart USING (account_code) LEFT JOIN parties p ON p.party_id = l.party_id)""")
cte("xml_lines", """
SELECT voucher_id, voucher_type, doc_key, account_code, CASE WHEN doc_key % 101 = 1 AND account_code IN (4010, 5010) THEN NULL
  ELSE -amt + CASE WHEN doc_key % 103 = 2 AND account_code IN (1030, 2010) THEN 100 ELSE 0 END END p FROM ledger WHERE NOT is_opening""")
cte("xml_vouchers", """
SELECT voucher_id, CASE WHEN any_value(doc_key) % 97 = 0 THEN 'date' WHEN count(p) < count(*) THEN 'amount' WHEN sum(p) <> 0 THEN 'unbalanced' ELSE '' END problem FROM xml_lines GROUP BY 1""")
SUMS = "count(*) lines, count(DISTINCT voucher_id) vouchers"
SQL = {
    "import_csv_history": build(f"SELECT account_name, problem, {SUMS}, {money('sum(debit_p)')} debit, {money('sum(credit_p)')} credit FROM csv_lines GROUP BY 1, 2"),
    "import_control": build(f"""SELECT account_name, {money('p')} net, side FROM (
 SELECT account_name, sum(debit_p - credit_p) p, 'imported' side FROM csv_lines WHERE problem = '' GROUP BY 1 UNION ALL SELECT account_name, sum(amt), 'source' FROM csv_lines GROUP BY 1)
 QUALIFY count(*) OVER (PARTITION BY account_name, p) = 1"""),
    "import_tally_xml": build(f"""SELECT voucher_type, problem, {SUMS}, {money('sum(greatest(-coalesce(p, 0), 0))')} debit, {money('sum(greatest(coalesce(p, 0), 0))')} credit
 FROM xml_lines JOIN xml_vouchers USING (voucher_id) GROUP BY 1, 2"""),
    "day_book": build("""SELECT client_id, voucher_id, voucher_type, posting_date, reverses_id,
 row_number() OVER (ORDER BY posting_date DESC NULLS LAST, reverses_id ASC NULLS LAST, voucher_id) AS position FROM vouchers"""),
}
