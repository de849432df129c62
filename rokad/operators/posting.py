"""Turning documents into balanced ledger legs. Amounts are signed paise; positive is a debit."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import masters as m
from ..functions import dates
from ..functions.money import rupees

LEDGER = [
    "firm_id", "client_id", "voucher_id", "voucher_type", "posting_date", "fy", "doc_key",
    "account_code", "debit", "credit", "signed_paise", "party_type", "party_id", "settles_voucher_id",
    "is_opening", "finance_book_id",
]


@dataclass
class Leg:
    account: int | Column
    amount: Column
    party_type: str | None = None
    party: Column | None = None
    settles: Column | None = None
    #: accounts that a computed account can be; None: any
    among: tuple[int, ...] | None = None

    def meets(self, accounts: set[int] | None) -> bool:
        """Whether the leg can lie on one of the accounts."""
        if accounts is None:
            return True
        own = {self.account} if isinstance(self.account, int) else self.among
        return own is None or bool(accounts & set(own))


@dataclass
class Voucher:
    """One voucher of a document row. Amounts are multiplied by `sign` after the explode."""
    id: Column
    kind: Column
    firm: Column
    client: Column
    date: Column
    legs: list[Leg]
    when: Column | None = None
    sign: Column | None = None
    #: vouchers of one side of a document have the same client
    side: int = 0
    #: set while exploding: the voucher exists and lies in the dates asked for (its mirror may lie in them by itself)
    own_when: Column | None = None


@dataclass
class Mirror:
    """A reversal of an earlier voucher of the same row: its legs with sides swapped, unsettled."""
    of: int
    id: Column
    date: Column
    when: Column


def within(date: Column, span: tuple[str | None, str | None]) -> Column:
    """Date condition of a span whose ends may be open."""
    out = F.lit(True)
    if span[0]:
        out = out & (date >= F.lit(span[0]).cast("date"))
    if span[1]:
        out = out & (date <= F.lit(span[1]).cast("date"))
    return out


def voucher_sums(docs: DataFrame, vouchers: list[Voucher], mirrors: list[Mirror] | None = None, span: tuple[str | None, str | None] = (None, None),
                 period: Callable[[Column], Column] | None = None, accounts: set[int] | None = None) -> DataFrame:
    """client_id, account_code, period, debit_paise, credit_paise, entries: sums over the legs that explode_vouchers would make, without making them.

    A document stays one row per side, with the amounts of its vouchers beside each other. What decides where they go (client, whether a voucher exists in
    the dates and its sign, its period, computed accounts) has few values, so rows are added up by it map-side; only these sums are laid out as accounts. A
    reversal has the amounts of its voucher, so it adds a sign and a period and no sums. Without `period`, that column is null. Positive and negative
    amounts are added up apart, as a leg is a debit or a credit by itself.
    """
    vouchers = [replace(v, legs=[g for g in v.legs if g.meets(accounts)]) for v in vouchers]
    every = [(n, v) for n, v in enumerate(vouchers)] + [
        (x.of, replace(vouchers[x.of], date=x.date, when=x.when if vouchers[x.of].when is None else x.when & vouchers[x.of].when,
                       sign=F.lit(-1) if vouchers[x.of].sign is None else -vouchers[x.of].sign)) for x in mirrors or []]
    sides = sorted({v.side for v in vouchers if v.legs})
    side, client = F.col("_side"), F.lit(None).cast("int")
    rows = docs.withColumn("_side", F.explode(F.array(*[F.lit(x) for x in sides])) if len(sides) > 1 else F.lit(sides[0]))
    keys, values, none = [], [], F.lit(None)
    for x in sides:
        client = F.when(side == x, next(v.client for v in vouchers if v.side == x).cast("int")).otherwise(client)
    for n, (_, v) in enumerate(every):
        live = (side == v.side) & within(v.date, span)
        live = live if v.when is None else live & v.when
        keys.append(F.when(live, F.lit(1) if v.sign is None else v.sign.cast("int")).otherwise(F.lit(0)).alias(f"s{n}"))
        keys.append((none.cast("string") if period is None else F.when(live, period(v.date))).alias(f"k{n}"))
    for n, v in enumerate(vouchers):
        for i, g in enumerate(v.legs):
            values.append(F.coalesce(g.amount, F.lit(0)).cast("long").alias(f"a{n}_{i}"))
            if not isinstance(g.account, int):
                # of no matter where the voucher does not exist, so that it divides no sums there
                keys.append(F.when(side == v.side, g.account.cast("int")).alias(f"c{n}_{i}"))
    rows = rows.select(client.alias("client_id"), *keys, *values)
    rows = rows.filter(" OR ".join(f"s{n} <> 0" for n in range(len(every))))
    by = [c for c in rows.columns if not c.startswith("a")]
    amounts = [c for c in rows.columns if c.startswith("a")]
    plus = [F.sum(F.greatest(F.col(c), F.lit(0))).alias(f"p{c}") for c in amounts]
    minus = [F.sum(F.greatest(-F.col(c), F.lit(0))).alias(f"m{c}") for c in amounts]
    sums = rows.groupBy(*by).agg(*plus, *minus, *[F.count_if(F.col(c) != 0).alias(f"n{c}") for c in amounts])
    laid = []
    for n, (of, v) in enumerate(every):
        sign = F.col(f"s{n}")
        for i, g in enumerate(v.legs):
            a = f"a{of}_{i}"
            up, down = F.col(f"p{a}"), F.col(f"m{a}")
            laid.append(F.when((sign != 0) & (F.col(f"n{a}") > 0), F.struct(
                (F.lit(g.account) if isinstance(g.account, int) else F.col(f"c{of}_{i}")).cast("int").alias("account_code"), F.col(f"k{n}").alias("period"),
                F.when(sign > 0, up).otherwise(down).alias("debit_paise"), F.when(sign > 0, down).otherwise(up).alias("credit_paise"),
                F.col(f"n{a}").alias("entries"))))
    out = sums.select("client_id", F.explode(F.array_compact(F.array(*laid))).alias("g")).select("client_id", "g.*")
    if accounts is not None:
        out = out.filter(F.col("account_code").isin(*accounts))
    return add_sums(out)


SUMS = ["debit_paise", "credit_paise", "entries"]


def add_sums(sums: DataFrame) -> DataFrame:
    """One row per client, account and period."""
    return sums.groupBy("client_id", "account_code", "period").agg(*[F.sum(x).alias(x) for x in SUMS])


def net_vouchers(docs: DataFrame, vouchers: list[Voucher], mirrors: list[Mirror] | None = None,
                 span: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """client_id, account_code, signed_paise: sums of the legs that explode_vouchers would make; see voucher_sums."""
    return voucher_sums(docs, vouchers, mirrors, span).select("client_id", "account_code", (F.col("debit_paise") - F.col("credit_paise")).alias("signed_paise"))


def voucher_accounts(docs: DataFrame, vouchers: list[Voucher], keys: list[str], mirrors: list[Mirror] | None = None) -> DataFrame:
    """voucher_id, debit_accounts, credit_accounts: the accounts of a voucher's legs by side, in ascending order, joined by commas.

    All legs of a voucher are on one row, so its accounts are bits of two numbers there, and no leg is made or moved. Rows that share an id are joined by
    these bits; `keys` are columns of the documents that an id determines, by which they already lie together.
    """
    codes = sorted({a for v in vouchers for g in v.legs for a in ((g.account,) if isinstance(g.account, int) else g.among)})
    bit = {a: 1 << n for n, a in enumerate(codes)}
    none = F.lit(0).cast("long")

    def side(v: Voucher, sign: int) -> Column:
        out = none
        for g in v.legs:
            own = F.lit(bit[g.account]).cast("long") if isinstance(g.account, int) else F.coalesce(
                *[F.when(g.account == a, F.lit(bit[a]).cast("long")) for a in g.among], none)
            out = out.bitwiseOR(F.when(g.amount > 0 if sign > 0 else g.amount < 0, own).otherwise(none))
        return out

    bits = docs.select("*", *[x for n, v in enumerate(vouchers) for x in (side(v, 1).alias(f"_u{n}"), side(v, -1).alias(f"_d{n}"))])
    rows = []
    for of, v, turned in [(n, v, False) for n, v in enumerate(vouchers)] + [
            (x.of, replace(vouchers[x.of], id=x.id, when=x.when if vouchers[x.of].when is None else x.when & vouchers[x.of].when), True) for x in mirrors or []]:
        up, down = F.col(f"_u{of}"), F.col(f"_d{of}")
        plus = (F.lit(1) if v.sign is None else v.sign) > 0
        plus = ~plus if turned else plus
        live = up.bitwiseOR(down) != 0
        rows.append(F.when(live if v.when is None else live & v.when, F.struct(
            v.id.alias("voucher_id"), F.when(plus, up).otherwise(down).alias("dr"), F.when(plus, down).otherwise(up).alias("cr"))))
    each = bits.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("v")).select(*keys, "v.*")
    each = each.groupBy(*keys, "voucher_id").agg(F.bit_or("dr").alias("dr"), F.bit_or("cr").alias("cr"))

    def listed(mask: str) -> Column:
        return F.concat_ws(",", *[F.when(F.col(mask).bitwiseAND(F.lit(b).cast("long")) != 0, F.lit(str(a))) for a, b in bit.items()])
    return each.select("voucher_id", listed("dr").alias("debit_accounts"), listed("cr").alias("credit_accounts"))


def explode_vouchers(docs: DataFrame, vouchers: list[Voucher], doc_key: str, mirrors: list[Mirror] | None = None,
                     accounts: set[int] | None = None, span: tuple[str | None, str | None] = (None, None), carry: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """One pass over the documents: all vouchers of a row become their non-zero legs.

    carry adds columns, {name: {party_type: value}}, of the document that a leg of such a party comes from.

    Only a primitive array of amounts is built per document; every other leg attribute is looked up
    from the leg position after zero legs are dropped, and is pruned when a report does not need it.
    With accounts and span, legs that can lie on none of the accounts, and vouchers outside the dates, are never built.
    """
    vouchers = [replace(v, legs=[g for g in v.legs if g.meets(accounts)]) for v in vouchers]
    if span != (None, None):
        live = [within(v.date, span) for v in vouchers]
        vouchers = [replace(v, own_when=w if v.when is None else v.when & w) for v, w in zip(vouchers, live, strict=True)]
        mirrors = [replace(x, when=x.when & within(x.date, span)) for x in mirrors or []]
        # documents without a voucher in the dates go before their amounts are computed
        docs = docs.filter(reduce(or_, [v.own_when for v in vouchers] + [x.when for x in mirrors]))
    null = F.lit(None).cast("string")
    amounts, owner, legs, start = [], [], [], {}
    for v_no, v in enumerate(vouchers):
        start[v_no] = len(legs)
        for g in v.legs:
            amounts.append(F.coalesce(g.amount if v.when is None else F.when(v.when, g.amount), F.lit(0)).cast("long"))
            owner.append(v_no)
            legs.append(g)
    every = list(vouchers)
    df = docs.withColumn("_amounts", F.array(*amounts))
    array = F.col("_amounts")
    if span != (None, None):
        live = F.array(*[vouchers[n].own_when for n in owner])
        array = F.zip_with("_amounts", live, lambda a, w: F.when(w, a).otherwise(F.lit(0).cast("long")))
    for mirror in mirrors or []:
        v = vouchers[mirror.of]
        part = F.slice("_amounts", start[mirror.of] + 1, len(v.legs))
        array = F.concat(array, F.when(mirror.when, part).otherwise(
            F.array(*[F.lit(0).cast("long")] * len(v.legs))))
        owner += [len(every)] * len(v.legs)
        legs += [replace(g, settles=None) for g in v.legs]
        sign = F.lit(-1) if v.sign is None else -v.sign
        every.append(replace(v, id=mirror.id, date=mirror.date, sign=sign))
    df = df.select("*", F.posexplode(array).alias("_pos", "_amount")).filter("_amount <> 0")
    pos = F.col("_pos")
    number = F.get(F.array(*[F.lit(n) for n in owner]), pos)

    def of_voucher(get: Callable[[Voucher], Column]) -> Column:
        out = get(every[-1])
        for n, v in reversed(list(enumerate(every[:-1]))):
            out = F.when(number == n, get(v)).otherwise(out)
        return out

    def of_leg(get: Callable[[Leg], Column | None]) -> Column:
        out = null
        for n, g in enumerate(legs):
            value = get(g)
            if value is not None:
                out = F.when(pos == n, value).otherwise(out)
        return out

    code = F.get(F.array(*[F.lit(g.account if isinstance(g.account, int) else None).cast("int") for g in legs]), pos)
    for n, g in enumerate(legs):
        if not isinstance(g.account, int):
            code = F.when(pos == n, g.account.cast("int")).otherwise(code)
    date = of_voucher(lambda v: v.date.cast("date"))
    signs = of_voucher(lambda v: (F.lit(1) if v.sign is None else v.sign).cast("long"))
    df = df.withColumn("_signed", F.col("_amount") * signs)
    amount = F.col("_signed")
    if accounts is not None and any(not isinstance(g.account, int) for g in legs):
        df = df.filter(code.isin(*accounts))
    return df.select(
        of_voucher(lambda v: v.firm.cast("int")).alias("firm_id"),
        of_voucher(lambda v: v.client.cast("int")).alias("client_id"),
        of_voucher(lambda v: v.id).alias("voucher_id"), of_voucher(lambda v: v.kind).alias("voucher_type"),
        date.alias("posting_date"), dates.fy_start(date).alias("fy"), F.col(doc_key).cast("long").alias("doc_key"),
        code.alias("account_code"), rupees(F.greatest(amount, F.lit(0))).alias("debit"),
        rupees(F.greatest(-amount, F.lit(0))).alias("credit"), amount.alias("signed_paise"),
        of_leg(lambda g: F.lit(g.party_type) if g.party_type else None).alias("party_type"),
        of_leg(lambda g: g.party).alias("party_id"), of_leg(lambda g: g.settles).alias("settles_voucher_id"),
        F.lit(False).alias("is_opening"), null.alias("finance_book_id"),
        *[of_leg(lambda g, own=own: own.get(g.party_type)).alias(name) for name, own in (carry or {}).items()])


def sales_legs(d: dict[str, Column], party: Column) -> list[Leg]:
    """Debtor against revenue per account, output tax and round-off; nothing is lost when cess is due."""
    return [
        Leg(m.DEBTORS, d["grand_total"], "customer", party),
        Leg(m.SALES, -d["rev_goods"]),
        Leg(m.SERVICE, -d["rev_service"]),
        Leg(m.OUT_CGST, -d["cgst"]),
        Leg(m.OUT_SGST, -d["sgst"]),
        Leg(m.OUT_IGST, -d["igst"]),
        Leg(m.OUT_CESS, -d["cess"]),
        Leg(m.ROUND_OFF, -d["round_off"]),
    ]


def receipt_legs(money_account: Column | int, cash: Column, tds: Column, party: Column, settles: Column) -> list[Leg]:
    return [
        Leg(money_account, cash, among=(m.CASH, m.BANK)),
        Leg(m.TDS_RECEIVABLE, tds),
        Leg(m.DEBTORS, -(cash + tds), "customer", party, settles),
    ]


def payment_legs(money_account: Column | int, gross: Column, tds: Column, party: Column, settles: Column) -> list[Leg]:
    return [
        Leg(m.CREDITORS, gross, "supplier", party, settles),
        Leg(m.TDS_PAYABLE, -tds),
        Leg(money_account, -(gross - tds), among=(m.CASH, m.BANK)),
    ]


def charge_legs(bank: Column | int, total: Column, gst: Column, intra: Column) -> list[Leg]:
    """A bank charge with its tax claimed: half to one head and the remainder to the other."""
    half = F.shiftright(gst, 1)
    return [
        Leg(m.BANK_CHARGES, total - gst),
        Leg(m.IN_CGST, F.when(intra, half)),
        Leg(m.IN_SGST, F.when(intra, gst - half)),
        Leg(m.IN_IGST, F.when(~intra, gst)),
        Leg(bank, -total),
    ]


def interest_legs(bank: Column | int, credited: Column, gross: Column) -> list[Leg]:
    """Interest recorded gross, the withheld part as a receivable."""
    return [Leg(bank, credited), Leg(m.TDS_RECEIVABLE, gross - credited), Leg(m.INTEREST, -gross)]


def reverse(ledger: DataFrame, reversals: DataFrame) -> DataFrame:
    """Reversal legs for (voucher_id, reversal_id, reversal_date): sides swapped, same parties."""
    r = reversals.select("voucher_id", "reversal_id", "reversal_date")
    j = ledger.join(r, "voucher_id")
    return j.select(
        "firm_id", "client_id", F.col("reversal_id").alias("voucher_id"), "voucher_type",
        F.col("reversal_date").alias("posting_date"), dates.fy_start(F.col("reversal_date")).alias("fy"),
        "doc_key", "account_code", F.col("credit").alias("debit"), F.col("debit").alias("credit"),
        (-F.col("signed_paise")).alias("signed_paise"), "party_type", "party_id", F.lit(None).cast("string").alias("settles_voucher_id"),
        "is_opening", "finance_book_id")
