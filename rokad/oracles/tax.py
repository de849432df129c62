"""Check queries for the tax jobs."""
from __future__ import annotations

from .. import masters as m
from .base import arr, build, check_digit, cond, cte, fy, money, q
from ..operators import vendor
from ..sources import returns as r
from ..functions import gstin as g

P = "strftime({}, '%Y-%m')"
SG = "(CASE WHEN is_return THEN -1 ELSE 1 END)"
cte("bucketed", f"""
SELECT *, {P.format('posting_date')} period, CASE WHEN is_return THEN CASE WHEN gst_category IN ('unregistered','overseas') THEN 'CDNUR' ELSE 'CDNR' END
  WHEN is_export THEN CASE WHEN export_type = 'with_payment' THEN 'EXPWP' ELSE 'EXPWOP' END WHEN gst_category = 'sez' THEN 'SEZ'
  WHEN gst_category <> 'unregistered' THEN 'B2B'
  WHEN NOT intra AND grand_p > CASE WHEN posting_date >= DATE '2024-08-01' THEN 10000000 ELSE 25000000 END THEN 'B2CL' ELSE 'B2CS' END bucket FROM sales""")
cte("inward", f"""
SELECT '2B-' || voucher_id line_id, client_id, supplier_gstin, CASE k WHEN 2 THEN lower(replace(bill_number, '/', '-')) WHEN 7 THEN '1NV' || substr(bill_number, 4) WHEN 10 THEN '1NV' || substr(bill_number, 4)
  WHEN 8 THEN 'N' || ok * 7919 WHEN 9 THEN 'SUB' || ok WHEN 11 THEN 'Z/' || ok ELSE bill_number END invoice_number,
  bill_date + CASE k WHEN 3 THEN 2 WHEN 7 THEN 1 WHEN 8 THEN -3 WHEN 9 THEN 40 ELSE 0 END invoice_date,
  CASE k WHEN 1 THEN taxable_p + 10000 WHEN 10 THEN taxable_p + 10000 WHEN 8 THEN taxable_p + 40 WHEN 9 THEN taxable_p * 2 ELSE taxable_p END taxable_p,
  2 * cgst_p + igst_p tax_p, k = 4 is_amended, CASE k WHEN 5 THEN 'pending' WHEN 6 THEN 'reject' ELSE 'accept' END ims
FROM (SELECT *, ok % 20 k FROM bills WHERE supplier_gstin IS NOT NULL AND NOT is_return AND ok % 20 <> 0)
UNION ALL SELECT '2X-' || voucher_id, client_id, supplier_gstin, 'X' || bill_number, bill_date, taxable_p, 2 * cgst_p + igst_p, false, 'accept'
FROM bills WHERE supplier_gstin IS NOT NULL AND NOT is_return AND ok % 25 = 0""")
NN = "upper(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
cte("rb", f"""SELECT voucher_id l, client_id, supplier_gstin, {NN.format('bill_number')} num, bill_number, bill_date, taxable_p bt, 2 * cgst_p + igst_p bx, ok FROM bills WHERE supplier_gstin IS NOT NULL AND NOT is_return""")
cte("rg", f"""SELECT line_id r, client_id, supplier_gstin, {NN.format('invoice_number')} num, invoice_number, invoice_date, taxable_p gt, tax_p gx, is_amended, ims FROM inward""")
cte("r0", """SELECT l, r, 'manual' matched_by FROM rb JOIN rg USING (client_id, supplier_gstin) WHERE ok % 20 = 9 AND invoice_number = 'SUB' || ok""")


def ranked_pass(name: str, keys: str, b_keys: str, g_keys: str, b_order: str, g_order: str, before: str, how: str) -> None:
    cte(name, f"""SELECT * FROM {before} UNION ALL SELECT l, r, '{how}' FROM
(SELECT l, {b_keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {b_order}, l) n FROM (SELECT *, bill_date d, bt v, bx x FROM rb WHERE l NOT IN (SELECT l FROM {before}))) JOIN
(SELECT r, {g_keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {g_order}, r) n FROM (SELECT *, invoice_date d, gt v, gx x FROM rg WHERE r NOT IN (SELECT r FROM {before}))) USING ({keys}, n)""")


ranked_pass("r1", "client_id, supplier_gstin, num", "client_id, supplier_gstin, num", "client_id, supplier_gstin, num", "d, v", "d, v", "r0", "number")
ranked_pass("r2", "client_id, supplier_gstin, d, v, x", "client_id, supplier_gstin, d, v, x", "client_id, supplier_gstin, d, v, x", "num", "num", "r1", "value")
cte("r_near", """
SELECT *, row_number() OVER (PARTITION BY client_id, supplier_gstin ORDER BY close * 2 + CASE WHEN e <= 1 THEN 2 ELSE 0 END DESC, e, gap, l, r) k FROM (
SELECT b.client_id, b.supplier_gstin, l, r, CASE WHEN abs(bt - gt) <= 100 AND abs(bx - gx) <= 100 AND abs(bill_date - invoice_date) <= 5 THEN 1 ELSE 0 END close,
  levenshtein(b.num, g.num) e, abs(bill_date - invoice_date) gap
FROM (SELECT * FROM rb WHERE l NOT IN (SELECT l FROM r2)) b JOIN (SELECT * FROM rg WHERE r NOT IN (SELECT r FROM r2)) g USING (client_id, supplier_gstin)
WHERE abs(bill_date - invoice_date) <= 5) WHERE close = 1 OR (gap = 0 AND e <= 1)""")
cte("r_greedy", """
SELECT DISTINCT client_id, supplier_gstin, CAST(0 AS BIGINT) k, []::VARCHAR[] used, NULL::VARCHAR l, NULL::VARCHAR r FROM r_near
UNION ALL SELECT client_id, supplier_gstin, k, CASE WHEN free THEN list_concat(used, [l, r]) ELSE used END, CASE WHEN free THEN l END, CASE WHEN free THEN r END FROM (
SELECT n.*, used, NOT list_contains(used, n.l) AND NOT list_contains(used, n.r) free FROM r_greedy g JOIN r_near n ON n.client_id = g.client_id AND n.supplier_gstin = g.supplier_gstin AND n.k = g.k + 1)""")
cte("r_all", "SELECT * FROM r2 UNION ALL SELECT l, r, 'near' FROM r_greedy WHERE l IS NOT NULL")
cte("recon", """
SELECT coalesce(b.client_id, g.client_id) client_id, coalesce(b.supplier_gstin, g.supplier_gstin) supplier_gstin, b.l voucher_id, bill_number, invoice_number, bt, gt, CASE WHEN g.r IS NULL THEN 'missing_in_2b'
  WHEN b.l IS NULL THEN 'missing_in_books' WHEN ims = 'pending' THEN 'pending' WHEN ims = 'reject' THEN 'ignored' WHEN is_amended THEN 'amended' WHEN matched_by = 'manual' THEN 'manual_match'
  WHEN bill_number = invoice_number AND bill_date = invoice_date AND bt = gt AND bx = gx THEN 'exact_match'
  WHEN abs(bt - gt) <= 100 AND abs(bx - gx) <= 100 AND abs(bill_date - invoice_date) <= 5 THEN 'suggested_match' ELSE 'mismatch' END status, matched_by
FROM rb b LEFT JOIN r_all p USING (l) FULL JOIN rg g ON g.r = p.r""")
cte("vendor_master", f"""
SELECT DISTINCT b.client_id, s.party_id, {arr(r.VENDOR_FIRST)}[s.sk % 7 + 1] || ' ' || {arr(r.VENDOR_SECOND)}[s.sk // 7 % 5 + 1] || ' ' || s.sk || ' ' || {arr(r.VENDOR_KIND)}[s.sk % 4 + 1] party_name, s.gstin
FROM bills b JOIN suppliers s ON s.sk = b.sk""")
cte("read_documents", """
SELECT voucher_id document_id, client_id, CASE WHEN k IN (3, 5) THEN 'Shop ' || sk * 31 WHEN k = 4 THEN upper(replace(replace(party_name, 'Trading', 'Trdg'), 'Company', 'Co.'))
  WHEN k = 6 THEN regexp_replace(party_name, ' [A-Za-z]+$', '') WHEN k = 7 THEN 'Nowhere Stores ' || ok ELSE party_name END AS name,
  CASE WHEN k < 4 THEN gstin WHEN k = 6 THEN substr(gstin, 1, 14) || '?' END gstin
FROM (SELECT b.voucher_id, b.client_id, b.ok, b.sk, b.ok % 8 k, m.party_name, m.gstin FROM bills b JOIN vendor_master m ON m.client_id = b.client_id AND m.party_id = 'S' || b.sk WHERE NOT is_return)""")
LONG = "CASE w " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in vendor.SHORT_FORMS.items()) + " ELSE w END"
WORDS = f"list_distinct(list_transform(list_filter(string_split_regex(lower({{}}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: {LONG}))"
cte("vendor_words", f"SELECT party_id, unnest({WORDS.format('party_name')}) word FROM (SELECT DISTINCT party_id, party_name FROM vendor_master)")
cte("word_weights", "SELECT word, length(bin((SELECT count(DISTINCT party_id) FROM vendor_words) // count(*))) w FROM vendor_words GROUP BY 1")
cte("v_number", "SELECT document_id, d.client_id, name, min(party_id) party_id FROM read_documents d LEFT JOIN vendor_master m ON m.client_id = d.client_id AND m.gstin = d.gstin GROUP BY 1, 2, 3")
cte("name_words", f"SELECT client_id, name, unnest({WORDS.format('name')}) word FROM (SELECT DISTINCT client_id, name FROM v_number WHERE party_id IS NULL)")
cte("name_sums", "SELECT client_id, name, sum(coalesce(w, length(bin((SELECT count(DISTINCT party_id) FROM vendor_words))))) total FROM name_words LEFT JOIN word_weights USING (word) GROUP BY 1, 2")
cte("v_name", """
SELECT client_id, name, min((-score, party_id)) best FROM (
SELECT client_id, name, party_id, CAST(shared * 1000 // (total + v_total - shared) AS INTEGER) score FROM (
SELECT n.client_id, n.name, m.party_id, sum(w) shared, any_value(s.total) total, any_value(v.v_total) v_total
FROM name_words n JOIN vendor_words x USING (word) JOIN word_weights USING (word) JOIN (SELECT DISTINCT client_id, party_id FROM vendor_master) m ON m.client_id = n.client_id AND m.party_id = x.party_id
JOIN name_sums s ON s.client_id = n.client_id AND s.name = n.name JOIN (SELECT party_id, sum(w) v_total FROM vendor_words JOIN word_weights USING (word) GROUP BY 1) v ON v.party_id = x.party_id
GROUP BY 1, 2, 3) WHERE shared * 100 >= 60 * (total + v_total - shared)) GROUP BY 1, 2""")
cte("v_habit", """
SELECT client_id, name, min((-n, party_id)) best FROM (SELECT client_id, name, party_id, count(*) n FROM v_number WHERE party_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2""")
HEAD_ROWS = "(VALUES ('cgst'), ('sgst'), ('igst')) h(head)"
cte("credit_moves", f"""
SELECT client_id, head, bill_date d, CASE head WHEN 'igst' THEN claim_igst_p ELSE claim_cgst_p END * {SG} o, 0 t FROM bills, {HEAD_ROWS}
UNION ALL SELECT client_id, head, CASE WHEN client_id % 4 <> 0 AND ok % 20 = 3 THEN bill_date + 2 ELSE bill_date END, 0,
  CASE head WHEN 'igst' THEN claim_igst_p ELSE claim_cgst_p END * {SG} * CASE WHEN client_id % 4 <> 0 AND ok % 50 = 7 THEN 2 ELSE 1 END
FROM bills, {HEAD_ROWS} WHERE client_id % 4 = 0 OR ok % 20 <> 0""")
cte("credit_gaps", """
SELECT *, CAST(sum(o - t) OVER (PARTITION BY client_id, head ORDER BY d) AS BIGINT) gap FROM (
SELECT client_id, head, d, CAST(sum(o) AS BIGINT) o, CAST(sum(t) AS BIGINT) t FROM credit_moves WHERE o <> 0 OR t <> 0 GROUP BY 1, 2, 3)""")
OWN = f"(CASE WHEN is_rcm THEN 0 ELSE {SG} END)"
cte("out_tax", f"""
SELECT client_id, {P.format('posting_date')} period, sum(taxable_p * {SG}) o_t, sum(cgst_p * {OWN}) o_c, sum(igst_p * {OWN}) o_i, sum(cess_due_p * {OWN}) o_x,
  sum(CASE WHEN is_export THEN taxable_p * {SG} ELSE 0 END) zr, sum(CASE WHEN NOT intra AND gst_category = 'unregistered' THEN taxable_p * {SG} ELSE 0 END) iu
FROM sales GROUP BY 1, 2""")
RC = f"(CASE WHEN is_rcm THEN {SG} ELSE 0 END)"
cte("in_tax", f"""
SELECT client_id, {P.format('bill_date')} period, sum(claim_cgst_p * {SG}) i_c, sum(claim_igst_p * {SG}) i_i,
  sum((2 * (cgst_p - claim_cgst_p) + igst_p - claim_igst_p) * {SG}) bl, sum(cgst_p * {RC}) r_c, sum(igst_p * {RC}) r_i FROM bills GROUP BY 1, 2""")
cte("summary", """
SELECT client_id, period, coalesce(o_t,0) o_t, coalesce(o_c,0) o_c, coalesce(o_i,0) o_i, coalesce(o_x,0) o_x, coalesce(zr,0) zr, coalesce(iu,0) iu,
  coalesce(i_c,0) i_c, coalesce(i_i,0) i_i, coalesce(bl,0) bl, coalesce(r_c,0) r_c, coalesce(r_i,0) r_i FROM out_tax FULL JOIN in_tax USING (client_id, period)""")
cte("so_months", "SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY period) rn FROM summary")
cte("setoff", """
SELECT DISTINCT client_id, '' period, CAST(0 AS BIGINT) rn, """ + ", ".join(f"CAST(0 AS BIGINT) {n}" for n in (
    "ii", "ic", "isx", "ccu", "ciu", "ssu", "siu", "cash_i", "cash_c", "cash_s", "cash_rcm", "left_i", "left_c", "left_s", "ki", "kc", "ks", "ni", "nc", "ns")) + """ FROM summary
UNION ALL SELECT client_id, period, rn, """ + ", ".join(f"CAST({e} AS BIGINT)" for e in (
    "ii", "ic", "isx", "ccu", "ciu", "ssu", "siu", "di - ii - ciu - siu", "dc - ic - ccu", "ds - isx - ssu", "rcm", "ci - ii - ic - isx", "cc - ccu - ciu", "cs - ssu - siu",
    "xi - ii - ic - isx", "xc - ccu - ciu", "xs - ssu - siu", "least(li, 0)", "least(lc, 0)", "least(ls, 0)")) + """
FROM (SELECT *, least(cs - ssu, di - ii - ciu) siu FROM (SELECT *, least(cc - ccu, di - ii) ciu, least(cs, ds - isx) ssu FROM (SELECT *, least(cc, dc - ic) ccu FROM (
 SELECT *, least(ci - ii - ic, ds) isx FROM (SELECT *, least(ci - ii, dc) ic FROM (SELECT *, least(ci, di) ii FROM (
 SELECT *, greatest(li, 0) di, greatest(lc, 0) dc, greatest(ls, 0) ds, greatest(xi, 0) ci, greatest(xc, 0) cc, greatest(xs, 0) cs FROM (
 SELECT m.client_id, m.period, m.rn, o_i + ni li, o_c + nc lc, o_c + ns ls, i_i + ki xi, i_c + kc xc, i_c + ks xs, greatest(2 * r_c + r_i, 0) rcm
 FROM setoff p JOIN so_months m ON m.client_id = p.client_id AND m.rn = p.rn + 1))))))))""")
cte("due_dates", """
SELECT *, CASE WHEN client_id % 2 = 1 THEN CAST(date_trunc('quarter', period_start) + INTERVAL 3 MONTH AS DATE) + 21 ELSE CAST(period_start + INTERVAL 1 MONTH AS DATE) + 19 END summary_due,
 CASE WHEN client_id % 2 = 1 THEN CAST(date_trunc('quarter', period_start) + INTERVAL 3 MONTH AS DATE) + 12 ELSE CAST(period_start + INTERVAL 1 MONTH AS DATE) + 10 END outward_due
FROM (SELECT DISTINCT client_id, CAST(date_trunc('month', posting_date) AS DATE) period_start FROM sales)""")


def heads(prefix: str = "", sign: str = "1") -> str:
    return ", ".join(f"{money(f'sum({c} * {sign})')} {n}" for c, n in (
        ("taxable_p", "taxable"), ("cgst_p", "cgst"), ("cgst_p", "sgst"), ("igst_p", "igst"), ("cess_due_p", "cess")))


def wise(names: str) -> str:
    cols = ", ".join(f"{money(c)} {n}" for c, n in (("taxable_p", "taxable"), ("cgst_p", "cgst"), ("cgst_p", "sgst"), ("igst_p", "igst"),
                                                  ("cess_due_p", "cess"), ("grand_p", "grand_total")))
    return build(f"SELECT client_id, period, bucket, voucher_id, party_gstin, place_of_supply, {cols} FROM bucketed WHERE bucket IN ({names})")


CATEGORY = "CASE expense_account " + " ".join(
    f"WHEN {a} THEN {q(c)}" for a, _, c in m.ITC_RULES) + " END"
RATE = "CAST({} AS DECIMAL(5,2))"
V = [("out_taxable", "o_t"), ("out_cgst", "o_c"), ("out_sgst", "o_c"), ("out_igst", "o_i"), ("out_cess", "o_x"), ("zero_rated", "zr"),
     ("inter_unregistered", "iu"), ("itc_cgst", "i_c"), ("itc_sgst", "i_c"), ("itc_igst", "i_i"), ("itc_blocked", "bl"), ("rcm_cgst", "r_c"),
     ("rcm_sgst", "r_c"), ("rcm_igst", "r_i")]
U = [("use_igst_igst", "ii"), ("use_igst_cgst", "ic"), ("use_igst_sgst", "isx"), ("use_cgst_cgst", "ccu"), ("use_cgst_igst", "ciu"),
     ("use_sgst_sgst", "ssu"), ("use_sgst_igst", "siu"), ("cash_igst", "cash_i"), ("cash_cgst", "cash_c"), ("cash_sgst", "cash_s"), ("cash_rcm", "cash_rcm"),
     ("left_igst", "left_i"), ("left_cgst", "left_c"), ("left_sgst", "left_s")]
G = "upper(trim(gstin))"
WHY = (f"CASE WHEN gstin IS NULL THEN 'empty' WHEN length({G}) <> 15 THEN 'length' WHEN NOT regexp_matches({G}, {q(g.LAYOUT)}) THEN 'layout' "
       f"WHEN {check_digit(f'substr({G}, 1, 14)')} <> substr({G}, 15, 1) THEN 'check_digit' END")
FYL = "CAST(f AS VARCHAR) || '-' || lpad(CAST((f + 1) % 100 AS VARCHAR), 2, '0')"
SQL = {
    "line_tax": build(f"SELECT voucher_id, pk, line_number, units, {money('price_p')} unit_price, {money('discount_p')} discount, {RATE.format('slab')} gst_rate, treatment, {money('taxable_p')} taxable, {money('cgst_p')} cgst, {money('cgst_p')} sgst, {money('igst_p')} igst, {money('cess_due_p')} cess FROM sales_lines"),
    "invoice_totals": build(f"SELECT voucher_id, {money('taxable_p')} taxable, {money('cgst_p')} cgst, {money('cgst_p')} sgst, {money('igst_p')} igst, {money('cess_due_p')} cess, {money('round_off_p')} round_off, {money('grand_p')} grand_total, intra, n_lines FROM sales"),
    "verify_tax": build(f"SELECT voucher_id, bill_number, {money('cgst_p')} cgst, {money('igst_p')} igst, {money('stated_cgst_p')} stated_cgst, {money('stated_igst_p')} stated_igst FROM bills WHERE stated_cgst_p <> cgst_p OR stated_igst_p <> igst_p"),
    "gstin_check": build(f"SELECT party_id, gstin, why reason, CASE WHEN why IS NULL THEN substr(gstin, 1, 2) END state, CASE WHEN why IS NULL THEN substr(gstin, 3, 10) END pan, coalesce(regexp_matches(substr(gstin, 3, 10), {q(g.PAN_LAYOUT)}), false) pan_valid FROM (SELECT *, {WHY} why FROM parties)"),
    "resolve_gst_rate": build(f"""SELECT hsn, {RATE.format('slab')} gst_rate, rate_id master_rate_id, r_rate master_gst_rate, count(*) lines FROM (
SELECT s.hsn, slab, r.rate_id, r.gst_rate r_rate FROM sales_lines s LEFT JOIN gst_rates r ON starts_with(s.hsn, hsn_prefix) AND posting_date >= effective_from) GROUP BY ALL"""),
    "resolve_threshold": build("SELECT voucher_id, CAST(CASE WHEN posting_date >= DATE '2024-08-01' THEN 100000 WHEN posting_date >= DATE '2017-07-01' THEN 250000 END AS DECIMAL(18,2)) b2cl_value FROM sales"),
    "resolve_period": build(f"""SELECT client_id, {FYL} fy, period_start, closed IS NOT NULL period_closed, count(*) documents FROM (SELECT client_id, {fy('posting_date')} f, CAST(date_trunc('month', posting_date) AS DATE) period_start FROM sales)
LEFT JOIN (SELECT DISTINCT client_id, CAST(date_trunc('month', posting_date) AS DATE) period_start, 1 closed FROM sales WHERE ok % 50 = 0) USING (client_id, period_start) GROUP BY ALL"""),
    "tds_computation": build(f"SELECT voucher_id, section_id, {money('amount_p')} amount, {money('cum_p')} cumulative_after, {money('base_p')} taxable_base, {money('tds_p')} tds, is_over AND NOT was_over threshold_crossed FROM tds_all WHERE section_id IS NOT NULL"),
    "tds_quarterly": build(f"SELECT client_id, year(payment_date) || '-Q' || quarter(payment_date) \"quarter\", party_id, section_id, {money('sum(amount_p)')} paid, {money('sum(tds_p)')} withheld, count(*) payments FROM tds_all WHERE tds_p > 0 GROUP BY 1, 2, 3, 4"),
    "tds_recon": build(f"SELECT client_id, {P.format('payment_date')} period, {money('sum(tds_p)')} withheld, {money('sum(tds_p)')} booked, true agrees FROM tds_all GROUP BY 1, 2 HAVING sum(tds_p) <> 0"),
    "bill_itc_header": build(f"SELECT voucher_id, itc_eligibility, {money('2 * claim_cgst_p + claim_igst_p')} itc_claimable, {money('2 * (cgst_p - claim_cgst_p) + igst_p - claim_igst_p')} itc_blocked, {money('claim_cgst_p')} claim_cgst, {money('claim_igst_p')} claim_igst FROM bills"),
    "itc_decide": build(f"""SELECT client_id, expense_account, lines, e eligibility, CASE WHEN category IS NULL THEN 'open'
 WHEN expense_account = 5140 THEN 'always_blocked:' || category WHEN e = 'eligible' THEN 'trade_exempt:' || category || ':' || buyer_trade
 WHEN e = 'blocked' THEN 'trade_blocked:' || category || ':' || buyer_trade ELSE 'trade_unknown:' || category END reason
FROM (SELECT client_id, buyer_trade, expense_account, {cond} e, {CATEGORY} category, count(*) lines FROM (SELECT buyer client_id, buyer_trade, expense_account FROM line_docs) GROUP BY ALL)"""),
    "ledger_divergence": build(f"""SELECT client_id, head, {money('sum(o)')} own_balance, {money('sum(t)')} other_balance, min(d) FILTER (gap <> 0) first_apart,
 {money('arg_min(gap, d) FILTER (gap <> 0)')} first_gap, {money('sum(o) - sum(t)')} closing_gap,
 CASE WHEN count(*) FILTER (gap <> 0) = 0 THEN 'equal' WHEN sum(o) = sum(t) THEN 'met_again' ELSE 'apart' END status FROM credit_gaps GROUP BY 1, 2"""),
    "resolve_vendor": build("""SELECT d.document_id, d.client_id, coalesce(d.party_id, n.best[2], h.best[2]) party_id,
 CASE WHEN d.party_id IS NOT NULL THEN 'number' WHEN n.best IS NOT NULL THEN 'name' WHEN h.best IS NOT NULL THEN 'history' ELSE 'unmatched' END found_by,
 CASE WHEN d.party_id IS NULL THEN -n.best[1] END score
FROM v_number d LEFT JOIN v_name n ON n.client_id = d.client_id AND n.name = d.name LEFT JOIN v_habit h ON h.client_id = d.client_id AND h.name = d.name"""),
    "recon_2b": build(f"SELECT client_id, supplier_gstin, voucher_id, bill_number, invoice_number, {money('bt')} b_taxable, {money('gt')} g_taxable, status, matched_by FROM recon"),
    "itc_claimable": build("""SELECT voucher_id, status, itc_eligibility = 'eligible' AND (status IN ('exact_match', 'manual_match') OR status = 'missing_in_2b' AND ov) claimable,
 CASE WHEN itc_eligibility = 'blocked' THEN 'not_creditable' WHEN itc_eligibility <> 'eligible' THEN 'undecided' WHEN status IN ('exact_match', 'manual_match') THEN 'reported'
 WHEN status = 'missing_in_2b' AND ov THEN 'overridden:supplier filed late' WHEN status = 'missing_in_2b' THEN 'unreported' ELSE 'held:' || status END reason FROM (SELECT b.voucher_id, b.itc_eligibility, ok % 40 = 0 ov, coalesce(r.status, 'missing_in_2b') status
 FROM bills b LEFT JOIN recon r ON r.voucher_id = b.voucher_id WHERE NOT is_return)"""),
    "itc_180_day": build(f"""SELECT client_id, voucher_id, bill_number, party_name supplier, bill_date, CAST(DATE '2026-12-31' - bill_date AS INTEGER) days_elapsed,
 {money('2 * claim_cgst_p + claim_igst_p')} itc_at_risk, DATE '2026-12-31' - bill_date > 180 breached FROM bills LEFT JOIN (SELECT settles_voucher_id v, sum(amount_p) p FROM payments GROUP BY 1) ON v = voucher_id
 WHERE NOT is_return AND approval_status = 'approved' AND 2 * claim_cgst_p + claim_igst_p > 0 AND DATE '2026-12-31' - bill_date >= 150 AND coalesce(p, 0) < grand_p"""),
    "itc_anomalies": build(f"""SELECT client_id, period, {money('claim')} claim, n AS months FROM (SELECT *, sum(claim) OVER w s, count(*) OVER w n FROM (SELECT client_id, period, 2 * i_c + i_i claim FROM in_tax)
 WINDOW w AS (PARTITION BY client_id ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) WHERE n > 0 AND claim * n * 10 > s * 13"""),
    "suppliers_never_in_2b": build("SELECT DISTINCT client_id, supplier_gstin FROM bills b WHERE supplier_gstin IS NOT NULL AND NOT EXISTS (SELECT 1 FROM inward i WHERE i.client_id = b.client_id AND i.supplier_gstin = b.supplier_gstin)"),
    "claim_deadline": build(f"""SELECT client_id, {FYL} fy, make_date(f + 1, 11, 30) deadline, {money('sum(c)')} unclaimed, count(*) bills, CAST(make_date(f + 1, 11, 30) - DATE '2027-03-31' AS INTEGER) days_left
 FROM (SELECT client_id, {fy('bill_date')} f, 2 * claim_cgst_p + claim_igst_p c FROM bills WHERE NOT is_return AND approval_status = 'pending_review') GROUP BY client_id, f"""),
    "gstr1_bucket": build("SELECT voucher_id, period, bucket FROM bucketed"),
    "gstr1_b2b": wise("'B2B','SEZ','B2CL'"), "gstr1_cdn": wise("'CDNR','CDNUR'"), "gstr1_exp": wise("'EXPWP','EXPWOP'"),
    "gstr1_b2cs": build(f"SELECT l.client_id, period, l.place_of_supply, {RATE.format('slab')} gst_rate, {heads().replace('taxable_p','l.taxable_p').replace('cgst_p','l.cgst_p').replace('igst_p','l.igst_p').replace('cess_due_p','l.cess_due_p')} FROM sales_lines l JOIN (SELECT voucher_id, period FROM bucketed WHERE bucket = 'B2CS') USING (voucher_id) WHERE treatment = 'taxable' GROUP BY ALL"),
    "gstr1_hsn": build(f"SELECT client_id, {P.format('posting_date')} period, hsn, uom, {RATE.format('slab')} gst_rate, CAST(sum(units * {SG}) AS DECIMAL(28,3)) quantity, {heads(sign=SG)} FROM sales_lines GROUP BY 1, 2, 3, 4, 5"),
    "gstr1_nil": build(f"SELECT client_id, {P.format('posting_date')} period, CASE WHEN intra THEN 'intra' ELSE 'inter' END supply, CASE WHEN gst_category IN ('unregistered','overseas') THEN 'unregistered' ELSE 'registered' END customer, treatment, {money('sum(taxable_p)')} taxable FROM sales_lines WHERE treatment IN ('nil_rated','exempt','non_gst') AND NOT is_return GROUP BY 1, 2, 3, 4, 5"),
    "gstr3b": build("SELECT client_id, period, " + ", ".join(f"{money(c)} {n}" for n, c in V) + " FROM summary"),
    "itc_set_off": build("SELECT client_id, period, " + ", ".join(f"{money(c)} {n}" for n, c in U) + " FROM setoff WHERE rn > 0"),
    "net_gst_payable": build(f"SELECT client_id, period, {money('2 * o_c + o_i')} output_tax, {money('2 * i_c + i_i')} input_tax, {money('2 * o_c + o_i - 2 * i_c - i_i')} net FROM summary"),
    "compliance_calendar": build("""SELECT client_id, period_start, return_name, due, due - 7 alert_7, due - 3 alert_3, due - 1 alert_1 FROM (SELECT client_id, period_start, 'GSTR-1' return_name, outward_due due FROM due_dates
 UNION ALL SELECT client_id, period_start, 'GSTR-3B', summary_due FROM due_dates)"""),
    "late_charges": build(f"""SELECT client_id, period, {money('cash')} cash, ld late_days, {money('(2 * cash * 18 * ld + 36500) // 73000')} interest, CAST(least(ld * 50, 10000) AS DECIMAL(18,2)) late_fee
 FROM (SELECT client_id, period, CAST(cash_i + cash_c + cash_s + cash_rcm AS BIGINT) cash FROM setoff WHERE rn > 0) JOIN (SELECT client_id, {P.format('period_start')} period, CAST((client_id * 7 + month(period_start)) % 12 AS INTEGER) ld FROM due_dates) USING (client_id, period) WHERE ld > 0"""),
    "validate_returns": build(f"SELECT client_id, {P.format('posting_date')} period, count(*) documents, true gv_1, true gv_2, true gv_4, true gv_6 FROM sales GROUP BY 1, 2"),
}
