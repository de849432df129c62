"""Check queries for statement ingestion: what was rendered must be read back."""
from __future__ import annotations

from .base import build, money

FID = "'F' || account_id || '-' || week"
KIND = "CASE account_id % 3 WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END"
WIDTH = KIND.format(7, 4, 6)


def column(name: str, kinds: list[int | None]) -> str:
    return f"CAST({KIND.format(*('NULL' if k is None else k for k in kinds))} AS INTEGER) {name}"


SQL = {
    "ingest_read": build(f"""SELECT {FID} file_id, line_key + 1000 line_no, {WIDTH} width FROM stated_lines
 UNION ALL SELECT {FID}, unnest([1, 2, 4, 5, 1152921504606846976]), unnest([1, 1, 2, {WIDTH}, 2]) FROM statements"""),
    "ingest_header": build(f"""SELECT {FID} file_id, CAST(5 AS BIGINT) header_line,
 {KIND.format("'HDFC Bank'", "'Generic (single signed amount column)'", "'Kotak Mahindra Bank'")} bank, {KIND.format("'dd/MM/yy'", "'dd/MM/yyyy'", "'dd-MM-yyyy'")} fmt,
 {column('c_txn_date', [0, 0, 0])}, {column('c_narration', [1, 1, 1])}, {column('c_debit', [4, None, None])}, {column('c_credit', [5, None, None])},
 {column('c_amount', [None, 2, 3])}, {column('c_flag', [None, None, 4])}, {column('c_balance', [6, 3, 5])} FROM statements"""),
    "ingest_rows": build(f"SELECT {FID} file_id, line_key + 1000 line_no, txn_date, trim(narration) narration, {money('debit_p')} debit, {money('credit_p')} credit, {money('stated_p')} running_balance FROM stated_lines"),
    "ingest_skipped": build(f"SELECT {FID} file_id, CAST(1152921504606846976 AS BIGINT) line_no, 'no parsable date in the date column' reason FROM statements"),
    "ingest_balances": build(f"SELECT {FID} file_id, {money('open_p')} opening_balance, {money('close_p')} closing_balance FROM statements"),
    "ingest_period": build(f"SELECT {FID} file_id, period_from, period_to FROM statements"),
    "group_continuations": build(f"""SELECT {FID} file_id, row_number() OVER w group_no, 2 * n line_no,
 CAST((n % 19 = 0)::INT + (n % 17 = 0)::INT + (n = last_n)::INT AS BIGINT) continuations,
 CASE WHEN n % 19 = 0 THEN 'Value Note' || n ELSE '' END || CASE WHEN n % 17 = 0 THEN 'REF ' || n ELSE '' END || CASE WHEN n = last_n THEN 'Closing Balance' || CAST({money('close_p')} AS VARCHAR) ELSE '' END extra
FROM (SELECT account_id, week, line_key + 1000 n, max(line_key + 1000) OVER (PARTITION BY account_id, week) last_n, close_p FROM stated_lines JOIN statements USING (account_id, week))
WINDOW w AS (PARTITION BY account_id, week ORDER BY n)"""),
    "repair_tokens": build("SELECT line_id, narration || '  22,196.' || lpad(CAST(line_key % 100 AS VARCHAR), 2, '0') || 'cr SBIN0000641' repaired FROM event_lines"),
}
