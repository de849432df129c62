"""Check queries for the books reports."""
from __future__ import annotations

from .base import D2, build, cte, money

AS_OF, FROM, TO = "2027-03-31", "2025-04-01", "2026-03-31"


def m(sum_: str) -> str:
    return money(f"coalesce({sum_}, 0)")


cte("tb", f"""
SELECT client_id, l.account_code, account_name, root_type, expense_class, liquidity_class, net_p,
  {money('greatest(net_p, 0)')} debit, {money('greatest(-net_p, 0)')} credit
FROM (SELECT client_id, account_code, CAST(sum(amt) AS BIGINT) net_p FROM ledger WHERE posting_date <= DATE '{AS_OF}' GROUP BY ALL) l
JOIN chart USING (account_code) WHERE net_p <> 0""")

SQL = {
    "trial_balance": build("SELECT client_id, account_code, account_name, root_type, debit, credit FROM tb"),
    "trial_balance_totals": build(f"SELECT client_id, CAST(sum(debit) AS {D2}) total_debit, CAST(sum(credit) AS {D2}) total_credit, "
                                  "sum(debit) = sum(credit) balanced FROM tb GROUP BY client_id"),
    "profit_and_loss": build(f"""
SELECT client_id, {money('rev')} revenue, {money('cogs')} cogs, {money('rev - cogs')} gross_profit, {money('opex')} operating_expenses,
  {money('rev - cogs - opex')} operating_profit, {money('nonop')} non_operating, {money('rev - cogs - opex - nonop')} net_profit FROM (
SELECT client_id, coalesce(sum(CASE WHEN root_type = 'income' THEN -amt END), 0) rev,
  coalesce(sum(CASE WHEN expense_class = 'cogs' THEN amt END), 0) cogs, coalesce(sum(CASE WHEN expense_class = 'opex' THEN amt END), 0) opex,
  coalesce(sum(CASE WHEN expense_class = 'non_operating' THEN amt END), 0) nonop
FROM ledger JOIN chart USING (account_code) WHERE posting_date BETWEEN DATE '{FROM}' AND DATE '{TO}'
  AND root_type IN ('income','expense') AND NOT is_opening GROUP BY client_id)"""),
    "balance_sheet": build(f"""
SELECT client_id, {money('ca')} current_assets, {money('nca')} non_current_assets, {money('cl')} current_liabilities,
  {money('ncl')} non_current_liabilities, {money('eq')} equity, {money('pl')} retained_profit, {money('ca+nca')} total_assets,
  {money('cl+ncl')} total_liabilities, {money('eq+pl')} total_equity, ca+nca = cl+ncl+eq+pl balanced, {money('ca-cl')} working_capital FROM (
SELECT client_id, coalesce(sum(CASE WHEN root_type='asset' AND liquidity_class='current' THEN net_p END),0) ca,
  coalesce(sum(CASE WHEN root_type='asset' AND coalesce(liquidity_class,'')<>'current' THEN net_p END),0) nca,
  coalesce(sum(CASE WHEN root_type='liability' AND liquidity_class='current' THEN -net_p END),0) cl,
  coalesce(sum(CASE WHEN root_type='liability' AND coalesce(liquidity_class,'')<>'current' THEN -net_p END),0) ncl,
  coalesce(sum(CASE WHEN root_type='equity' THEN -net_p END),0) eq,
  coalesce(sum(CASE WHEN root_type IN ('income','expense') THEN -net_p END),0) pl FROM tb GROUP BY client_id)"""),
    "account_ledger": build(f"""
SELECT client_id, account_code, posting_date, voucher_id, voucher_type, party_id, debit, credit,
  {money('sum(amt) OVER (PARTITION BY client_id, account_code ORDER BY posting_date, doc_key, voucher_id, coalesce(party_id, chr(32)))')} running_balance,
  {money('coalesce(opening, 0)')} opening_balance
FROM ledger LEFT JOIN (SELECT client_id, account_code, sum(amt) opening FROM ledger WHERE posting_date < DATE '{FROM}' GROUP BY ALL) o
  USING (client_id, account_code)
WHERE posting_date BETWEEN DATE '{FROM}' AND DATE '{TO}'"""),
}
