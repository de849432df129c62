"""Bank-narration parsing, amount cells, token repair, hashes and name normalisation."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import MONEY, zero

# Narration rules in the order they are tried —
# (rule, mode, pattern, reference group, counterparty group).
NARRATION_RULES = [
    ("upi_slash", "upi", r"(?i)^UPI[/-](\d{9,18})[/](?:[^/]*[/])?([^/]*)", 1, 2),
    ("upi_generic", "upi", r"(?i)\bUPI\b.*?\b(\d{9,18})\b", 1, 0),
    ("neft", "neft", r"(?i)^NEFT[\s/-]+([A-Z0-9]+)[\s/-]+([^-/]+?)(?:[\s/-]+UTR\s*([A-Z0-9]+))?$", 1, 2),
    ("rtgs", "rtgs", r"(?i)^RTGS[\s/-]+([A-Z0-9]+)[\s/-]+(.+?)$", 1, 2),
    ("imps", "imps", r"(?i)^IMPS[/-](?:[A-Z0-9]{3}[/-])?(\d{6,18})[/-]([^/]+)", 1, 2),
    ("cheque_paid", "cheque", r"(?i)\bCHQ(?:UE)?\s*(?:PAID|NO|CLG)?\s*[-:.#]?\s*(\d{5,6})\b", 1, 0),
    ("cheque_clearing", "cheque", r"(?i)\bCLG\b.*?\b(\d{6})\b", 1, 0),
    ("nach", "nach", r"(?i)^(?:NACH|ACH)\s*(?:DR|CR|C|D)?[\s-]+(.+?)(?:[\s-]+MANDATE\s*(\S+)|-(\d{6,}))?$", 3, 1),
    ("card_bill_payment", "card",
     r"(?i)\b(?:IB\s+)?BILLPAY\s*(?:DR|CR)?\b[\s-]*([A-Z0-9]+)?[\s-]*([0-9X]{8,20})?", 2, 0),
    ("atm", "atm", r"(?i)\bATM\s*(?:WDL|WITHDRAWAL|CASH)\b.*?(\d{4,8})?", 1, 0),
    ("cash", "cash", r"(?i)^(?:BY|TO)\s+CASH\b", 0, 0),
    ("interest", "interest", r"(?i)\b(?:INT\.?\s*(?:PD|CR|PAID|CREDIT)|INTEREST\s+(?:CREDIT|PAID))\b", 0, 0),
    ("charge", "charge",
     r"(?i)\b(?:SMS\s*CHARGES?|SERVICE\s*CHARGES?|AMC|ACCOUNT\s*MAINT|CHQ\s*RETURN\s*CHARGES?"
     r"|BANK\s*CHARGES?|DEBIT\s*CARD\s*(?:AMC|FEE))\b", 0, 0),
    ("card", "card", r"(?i)\b(?:POS|DEBIT\s*CARD|CREDIT\s*CARD)\b", 0, 0),
    ("transfer", "transfer", r"(?i)^(?:TRF|TRANSFER|FT)\b[\s/-]*(.*)$", 0, 1),
]
# A bank transaction reference, and the branch code it must not be confused with.
UTR = r"\b(?:UTR[:\s-]*)?([A-Z]{4}[A-Za-z]?\d{6,18})\b"
IFSC = r"^[A-Z]{4}0[A-Z0-9]{6}$"


def tidy(text: Column) -> Column:
    """Collapse spaces, trim punctuation; null when one character or less is left."""
    s = F.regexp_replace(text, r"\s+", " ")
    s = F.trim(F.regexp_replace(s, r"^[\s\-/:.]+|[\s\-/:.]+$", ""))
    return F.when(F.length(s) > 1, s)


def find_utr(text: Column) -> Column:
    """First reference-shaped token that is not a branch code."""
    tokens = F.regexp_extract_all(text, F.lit(UTR), F.lit(1))
    return F.get(F.filter(tokens, lambda t: ~F.upper(t).rlike(IFSC)), F.lit(0))


def narration_rule(narration: Column) -> Column:
    """Name of the first rule that fires, or null."""
    text = F.trim(narration)
    branch = None
    for name, _, pattern, _, _ in NARRATION_RULES:
        hit = text.rlike(pattern)
        branch = F.when(hit, name) if branch is None else branch.when(hit, name)
    return branch


def parse_narration(narration: Column, rule: Column) -> dict[str, Column]:
    """mode, reference and counterparty, given the rule that fired (see narration_rule)."""
    text = F.trim(narration)
    mode = positional = party = None
    for name, kind, pattern, ref, cp in NARRATION_RULES:
        at = rule == name
        ref_text = tidy(F.regexp_extract(text, pattern, ref)) if ref else F.lit(None).cast("string")
        cp_text = tidy(F.regexp_extract(text, pattern, cp)) if cp else F.lit(None).cast("string")
        mode = F.when(at, kind) if mode is None else mode.when(at, kind)
        positional = F.when(at, ref_text) if positional is None else positional.when(at, ref_text)
        party = F.when(at, cp_text) if party is None else party.when(at, cp_text)
    utr = find_utr(text)
    reference = F.when(mode == "upi", F.coalesce(positional, utr)).otherwise(F.coalesce(utr, positional))
    return {"payment_mode": mode, "reference": reference, "counterparty": party}


def line_hint(mode: Column, inbound: Column) -> Column:
    """What a line probably is when nothing matches it."""
    return (
        F.when(mode == "charge", "bank_charge")
        .when(mode == "interest", F.when(inbound, "interest").otherwise("bank_charge"))
        .when(mode == "cheque", "cheque")
    )


def amount_parts(raw: Column) -> dict[str, Column]:
    """blank, paren, marker (dr, cr or empty) and body (sign and digits) of an amount cell; a pattern is only tried where a plain test lets it match."""
    s = F.trim(raw)
    blank = (s == "") | (s == "-") | (s == "–") | (F.lower(F.substring(s, 1, 1)).eqNullSafe("n") & s.rlike("(?i)^nil$"))
    paren = s.startswith("(") & s.rlike(r"^\(.*\)$")
    inner = F.when(paren, F.regexp_extract(s, r"^\((.*)\)$", 1)).otherwise(s)
    marked = inner.contains("r") | inner.contains("R")
    marker = F.when(marked, F.lower(F.regexp_extract(inner, r"(?i)\s*(dr|cr)\.?$", 1))).otherwise("")
    body = F.when(marked, F.regexp_replace(inner, r"(?i)\s*(dr|cr)\.?$", "")).otherwise(inner)
    return {"blank": blank, "paren": paren, "marker": marker, "body": F.translate(body, "₹$, \t\n\x0b\f\r", "")}


def amount_of(blank: Column, paren: Column, marker: Column, body: Column) -> Column:
    """struct(value, negative, suffix, blank, valid) of the parts of an amount cell; value is never negative."""
    minus = body.startswith("-")
    digits = F.when(minus | body.startswith("+"), F.substring(body, F.lit(2), F.length(body))).otherwise(body)
    empty = digits == ""
    valid = blank | empty | digits.rlike(r"^\d+(\.\d+)?$")
    # third decimal decides; later ones are ignored
    point = F.instr(digits, ".")
    cut = F.when((point > 0) & (F.length(digits) - point > 3), F.regexp_replace(digits, r"^(\d+(?:\.\d{1,3})?)\d*$", "$1")).otherwise(digits)
    value = F.round(cut.try_cast("decimal(21,3)"), 2).cast(MONEY)
    negative = (paren | (marker == "dr")) != minus
    none = blank | empty
    return F.struct(
        F.when(none, zero()).when(valid, value).alias("value"),
        F.when(none, F.lit(False)).otherwise(negative).alias("negative"),
        F.when(~blank & (marker != ""), marker).alias("suffix"),
        none.alias("blank"),
        valid.alias("valid"),
    )


def parse_amount(raw: Column) -> Column:
    """Amount cell to struct(value, negative, suffix, blank, valid); value is never negative."""
    return amount_of(**amount_parts(raw))


def looks_numeric(raw: Column) -> Column:
    a = parse_amount(raw)
    return a["valid"] & ~a["blank"]


def signed_amount(raw: Column) -> Column:
    """Signed value of a numeric cell, null when blank or not a number."""
    return signed(parse_amount(raw))


def signed(a: Column) -> Column:
    """The same from a parsed cell."""
    return F.when(
        a["valid"] & ~a["blank"], F.when(a["negative"], -a["value"]).otherwise(a["value"]).cast(MONEY)
    )


# Glyph confusions that can be repaired without guessing.
_DR_CR = r"(?i)^([\d,.]*\d)([cd])([rziltf])(\.?)$"
_DOTTED = r"^\d{1,3}(?:\.\d{2,3})+\.\d{2}$"
_IFSC_LETTER_O = r"^([A-Z]{4})O([A-Z0-9]{6})$"


def _fix_dotted(token: Column) -> Column:
    groups = F.split(token, r"\.")
    n = F.size(groups)
    thousands = F.exists(F.slice(groups, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda g: F.length(g) == 3)
    joined = F.concat(F.array_join(F.slice(groups, F.lit(1), n - 1), ","), F.lit("."), F.element_at(groups, -1))
    return F.when(token.rlike(_DOTTED) & thousands, joined).otherwise(token)


def repair_token(token: Column) -> Column:
    """Repair one token: Dr/Cr glyphs, dotted thousands, letter O in a branch code. Keeps the length."""
    marked = token.rlike(_DR_CR)
    body = F.when(marked, F.regexp_extract(token, _DR_CR, 1)).otherwise(token)
    body = _fix_dotted(body)
    second = F.regexp_extract(token, _DR_CR, 3)
    r = F.when(second.rlike("^[A-Z]$"), "R").otherwise("r")
    with_marker = F.concat(body, F.regexp_extract(token, _DR_CR, 2), r, F.regexp_extract(token, _DR_CR, 4))
    return (
        F.when(marked, with_marker)
        .when(token.rlike(_IFSC_LETTER_O), F.regexp_replace(token, _IFSC_LETTER_O, "$10$2"))
        .otherwise(body)
    )


def repair_text(text: Column) -> Column:
    """Repair every token, leaving the whitespace as it was."""
    tokens = F.transform(F.split(text, r"\s+"), repair_token)
    gaps = F.concat(F.regexp_extract_all(text, F.lit(r"(\s+)"), F.lit(1)), F.array(F.lit("")))
    return F.array_join(F.transform(F.arrays_zip(tokens.alias("t"), gaps.alias("g")), lambda z: F.concat(z[
        "t"], z["g"])), "")


def money_text(value: Column) -> Column:
    """Canonical two-place text of an amount, as used in hashes."""
    return value.cast(MONEY).cast("string")


def line_hash(account: Column, date: Column, debit: Column, credit: Column, narration: Column,
              balance: Column) -> Column:
    """Content hash of a bank line; amounts in canonical form so 0 and 0.00 agree."""
    return F.sha2(
        F.concat_ws(
            "|", account.cast("string"), date.cast("string"), money_text(debit), money_text(credit),
            F.trim(F.regexp_replace(narration, r"\s+", " ")), F.coalesce(money_text(balance), F.lit("")),
        ), 256)


def account_hash(number: Column) -> Column:
    return F.sha2(F.upper(F.regexp_replace(number, r"\s", "")), 256)


def norm_invoice_no(number: Column) -> Column:
    return F.upper(F.regexp_replace(number, "[^A-Za-z0-9]", ""))


def norm_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " "))
