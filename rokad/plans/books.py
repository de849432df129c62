"""Further books jobs: roll-ups, ageing, closing entries, numbering, quality gates, lineage."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import masters as m
from ..functions import dates, gstin, text
from ..functions.money import MONEY, nonnull, rupees, zero
from ..operators.prefix import carry_forward, ordinal
from .reports import net_by


def scope(df: DataFrame, firm_id: int, via: DataFrame | None = None, key: str = "voucher_id") -> DataFrame:
    """Rows of one firm; child rows without a firm are limited through their parent."""
    if via is None:
        return df.filter(F.col("firm_id") == firm_id)
    return df.join(via.filter(F.col("firm_id") == firm_id).select(key), key, "left_semi")


def voucher_status(vouchers: DataFrame) -> DataFrame:
    r = vouchers.filter("reverses_id IS NOT NULL").select(
        F.col("reverses_id").alias("voucher_id"), F.col("voucher_id").alias("reversed_by"))
    return vouchers.join(r, "voucher_id", "left").select(
        "client_id", "voucher_id", "voucher_type", "reversed_by",
        F.when(F.col("reversed_by").isNotNull(), "reversed").otherwise("posted").alias("effective_status"))


def ageing(open_docs: DataFrame, as_of: str) -> DataFrame:
    """Outstanding per client and party in day buckets counted from the document date."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("document_date"))
    d = open_docs.filter(age >= 0).withColumn("_a", age)
    due, a = F.col("outstanding"), F.col("_a")

    def part(cond: Column, name: str) -> Column:
        return nonnull(F.sum(F.when(cond, due))).alias(name)

    return d.groupBy("client_id", "party_id").agg(
        part(a <= 30, "d0_30"), part((a > 30) & (a <= 60), "d31_60"), part((a > 60) & (a <= 90), "d61_90"),
        part((a > 90) & (a <= 180), "d91_180"), part(a > 180, "over_180"), F.sum(due).cast(MONEY).alias("total"))


def period_rollup(legs: DataFrame) -> DataFrame:
    """Monthly debit, credit and net per account; a cache that can be rebuilt at any time."""
    return legs.filter(F.col("finance_book_id").isNull()).groupBy(
        "client_id", "account_code", F.date_format("posting_date", "yyyy-MM").alias("period")).agg(
        rupees(F.sum(F.greatest("signed_paise", F.lit(0)))).alias("debit"),
        rupees(F.sum(F.greatest(-F.col("signed_paise"), F.lit(0)))).alias("credit"))


def rollup_of(sums: DataFrame) -> DataFrame:
    """period_rollup from monthly sums (client_id, account_code, period: first day, debit_paise, credit_paise)."""
    return sums.select("client_id", "account_code", F.date_format("period", "yyyy-MM").alias("period"),
                       rupees(F.col("debit_paise")).alias("debit"), rupees(F.col("credit_paise")).alias("credit"))


def ancestors(groups: list[tuple]) -> list[tuple]:
    """(group, every group above it and itself) of a literal chart of any depth; a loop is an error."""
    above = {code: parent for code, _, _, parent in groups}
    out = []
    for code in above:
        at, seen = code, set()
        while at is not None:
            if at in seen:
                raise ValueError(f"chart group {at} is above itself")
            seen.add(at)
            out.append((code, at))
            at = above[at]
    return out


def chart_rollup(legs: DataFrame, chart: DataFrame, groups: list[tuple], as_of: str) -> DataFrame:
    """Net of every chart group: each leaf climbs to all groups above it. Chart and groups are literal masters."""
    spark = legs.sparkSession
    net = net_by(legs.filter(F.col("posting_date") <= F.lit(as_of).cast("date")), "client_id", "account_code")
    names = m.literal_table(spark, groups, "code int, name string, root_type string, parent_code int").drop("parent_code")
    up = m.literal_table(spark, ancestors(groups), "parent_code int, code int")
    lift = net.join(F.broadcast(chart.select("account_code", "parent_code")), "account_code").join(F.broadcast(up), "parent_code")
    s = lift.groupBy("client_id", "code").agg(F.sum("net").cast(MONEY).alias("net"))
    return s.join(F.broadcast(names), "code")


def flux(rollup: DataFrame) -> DataFrame:
    """Change of each account's movement against the previous month with activity."""
    w = W.partitionBy("client_id", "account_code").orderBy("period")
    d = rollup.withColumn("net", (F.col("debit") - F.col("credit")).cast(MONEY)).withColumn("previous", F.lag("net").over(w))
    return d.filter("previous IS NOT NULL").select(
        "client_id", "account_code", "period", "net", "previous", (F.col("net") - F.col("previous")).cast(MONEY).alias("change"))


def year_close(legs: DataFrame, chart: DataFrame) -> DataFrame:
    """Closing legs per client and year: income and expense to zero, the result to reserves."""
    pl = F.broadcast(chart.filter(F.col("root_type").isin("income", "expense")).select("account_code"))
    return year_close_of(net_by(legs.filter("NOT is_opening").join(pl, "account_code"), "client_id", "fy", "account_code"))


def year_close_of(net: DataFrame) -> DataFrame:
    """The same from the net (client_id, fy, account_code, net) of income and expense accounts."""
    net = net.filter("net <> 0")
    back = net.select("client_id", "fy", "account_code", (-F.col("net")).cast(MONEY).alias("amount"))
    total = net.groupBy("client_id", "fy").agg(F.sum("net").cast(MONEY).alias("amount")).select(
        "client_id", "fy", F.lit(m.RESERVES).alias("account_code"), "amount")
    return back.unionByName(total).filter("amount <> 0").select(
        "client_id", F.concat(F.lit("YC-"), "client_id", F.lit("-"), "fy").alias("voucher_id"),
        dates.fy_end_date(F.col("fy")).alias("posting_date"), F.col("account_code").cast("int").alias("account_code"),
        F.greatest("amount", zero()).alias("debit"), F.greatest(-F.col("amount"), zero()).cast(MONEY).alias("credit"))


def depreciation(assets: DataFrame) -> DataFrame:
    """Straight-line monthly charge per asset and finance book; the last month takes the remainder."""
    n = F.col("life_months")
    monthly = F.floor(F.col("cost").cast("decimal(20,2)") / n, 2).cast(MONEY)
    runs = assets.select("*", F.explode(F.sequence(F.lit(1), n)).alias("i"), monthly.alias("_m"))
    amount = F.when(F.col("i") == n, F.col("cost") - F.col("_m") * (n - 1)).otherwise(F.col("_m")).cast(MONEY)
    return runs.select("client_id", "asset_id", "finance_book_id",
                       F.last_day(F.add_months("start_date", F.col("i") - 1)).alias("posting_date"), amount.alias("amount"))


def allocate_numbers(docs: DataFrame, series: str, span: int = 65536) -> DataFrame:
    """Gapless numbers per client and fiscal year in posting order, with the 16-character rule checked."""
    d = docs.withColumn("fy", dates.fy_start(F.col("posting_date"))).withColumn("_chunk", F.floor(F.col("ok") / span))
    d = ordinal(d, ["client_id", "fy"], ["posting_date", "_chunk"], ["posting_date", "ok", "sk"], "number")
    label = F.substring(dates.fy_label(F.col("fy")), 3, 5)
    text_no = F.concat(F.lit(series + "/"), label, F.lit("/"), F.lpad(
        F.col("number").cast("string"), F.greatest(F.length(F.col("number").cast("string")), F.lit(4)), F.lit("0")))
    return d.select("client_id", "fy", "voucher_id", "number", text_no.alias("document_number"),
                    text_no.rlike("^[A-Za-z0-9/-]{1,16}$").alias("valid"))


def series_ranges(numbered: DataFrame) -> DataFrame:
    """Unbroken ranges of a number series (client_id, fy, number, cancelled) with issued and cancelled counts.

    A number starts a range when its predecessor is absent; ends are found the same way, and the
    n-th start belongs to the n-th end. No range of one client is gathered in a single row group.
    """
    keys = ["client_id", "fy"]
    d = numbered.withColumn("_chunk", F.floor(F.col("number") / 65536))
    d = carry_forward(d, keys, ["_chunk"], ["number"], {"_prev": F.col("number")})
    starts = d.filter(F.col("_prev").isNull() | (F.col("_prev") < F.col("number") - 1))
    s = ordinal(starts, keys, ["_chunk"], ["number"], "range_no").select(*keys, "range_no", F.col("number").alias("from_number"))
    down = numbered.withColumn("_chunk", -F.floor(F.col("number") / 65536)).withColumn("_neg", -F.col("number"))
    down = carry_forward(down, keys, ["_chunk"], ["_neg"], {"_next": F.col("number")})
    ends = down.filter(F.col("_next").isNull() | (F.col("_next") > F.col("number") + 1)).withColumn(
        "_chunk", F.floor(F.col("number") / 65536))
    e = ordinal(ends, keys, ["_chunk"], ["number"], "range_no").select(*keys, "range_no", F.col("number").alias("to_number"))
    r = s.join(e, [*keys, "range_no"])
    return r.select(*keys, "range_no", "from_number", "to_number", (F.col("to_number") - F.col("from_number") + 1).alias("issued"))


def control_totals(legs: DataFrame, rollup: DataFrame, as_of: str) -> DataFrame:
    """Rows and sums of the ledger per client, tied to the stored period roll-up (whole months up to the date)."""
    p = F.col("signed_paise")
    sums = legs.filter((F.col("posting_date") <= F.lit(as_of).cast("date")) & F.col("finance_book_id").isNull()).groupBy("client_id").agg(
        F.sum(F.greatest(p, F.lit(0))).alias("debit_paise"), F.sum(F.greatest(-p, F.lit(0))).alias("credit_paise"), F.count(F.lit(1)).alias("entries"))
    return control_totals_of(sums, rollup, as_of)


def control_totals_of(sums: DataFrame, rollup: DataFrame, as_of: str) -> DataFrame:
    """The same from any sums of the ledger's legs up to the date (client_id, debit_paise, credit_paise, entries)."""
    on = F.lit(as_of).cast("date")
    g = sums.groupBy("client_id").agg(F.sum("entries").alias("entries"), rupees(F.sum("debit_paise")).alias("sum_debit"), rupees(F.sum("credit_paise")).alias("sum_credit"))
    t = rollup.filter(F.col("period") <= F.date_format(on, "yyyy-MM")).groupBy("client_id").agg(
        F.sum("debit").cast(MONEY).alias("tb_debit"), F.sum("credit").cast(MONEY).alias("tb_credit"))
    c = F.col
    return g.join(t, "client_id", "full_outer").select(
        "*", (c("sum_debit") == c("sum_credit")).alias("self_balancing"),
        ((c("sum_debit") == c("tb_debit")) & (c("sum_credit") == c("tb_credit"))).alias("ties"))


def against_accounts(legs: DataFrame) -> DataFrame:
    """Accounts on the other side of each leg of a voucher; a side holds at most the chart's leaves."""
    dr = F.col("signed_paise") > 0
    v = legs.groupBy("voucher_id").agg(
        F.sort_array(F.collect_set(F.when(dr, F.col("account_code")))).alias("_dr"),
        F.sort_array(F.collect_set(F.when(~dr, F.col("account_code")))).alias("_cr"))
    return v.select("voucher_id", F.array_join(F.col("_dr").cast("array<string>"), ",").alias("debit_accounts"),
                    F.array_join(F.col("_cr").cast("array<string>"), ",").alias("credit_accounts"))


# ---- quality gates ------------------------------------------------------------------------------
def finding(df: DataFrame, rule: str, cond: Column, key: Column) -> DataFrame:
    return df.filter(cond).select(F.lit(rule).alias("rule"), key.alias("key"))


def findings(df: DataFrame, key: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    """(rule, key) of every row rule that a row breaks, all rules in one pass.

    An outer explode, because an inner one is given a filter on its array, which goes down to the scan with all rules written out once more.
    """
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules]))
    return df.select(key.alias("key"), broken.alias("broken")).select(F.explode_outer("broken").alias("rule"), "key").filter("rule IS NOT NULL")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def validate_ledger(legs: DataFrame, vouchers: DataFrame, chart: DataFrame, closed: DataFrame, submitted: DataFrame, documents: DataFrame) -> DataFrame:
    """Voucher and leg rules: balance, two lines, one-sided legs, known leaf, party, open period, number, tax, approver, duplicates.

    submitted has voucher_id, tax (as it came) and recomputed (from the lines); documents have client_id, party_id, amount, document_date, reference, voucher_id.
    Duplicates and numbers are reported by what they share.
    """
    c = F.col
    v = legs.filter("NOT is_opening").groupBy("voucher_id").agg(F.sum("signed_paise").alias("net"), F.count(F.lit(1)).alias("n"))
    needs = legs.join(F.broadcast(chart.select("account_code", "account_type")), "account_code", "left")
    both = (c("debit") > 0) == (c("credit") > 0)
    late = vouchers.withColumn("period_start", dates.month_start(c("posting_date"))).join(
        closed.withColumn("_closed", F.lit(True)), ["client_id", "period_start"], "left")
    return _union([
        findings(v, c("voucher_id"), [("V-1", c("net") != 0), ("V-2", c("n") < 2)]),
        findings(needs, F.concat_ws("/", "voucher_id", c("account_code").cast("string")), [
            ("V-3", both), ("V-4", c("account_type").isNull()),
            ("V-5", c("account_type").isin("receivable", "payable") & c("party_id").isNull()),
            ("V-10", (c("account_code") == m.ROUND_OFF) & (F.abs("signed_paise") > 100))]),
        findings(late, c("voucher_id"), [
            ("V-6", c("_closed").isNotNull()), ("V-12", (c("created_via") == "ai_proposal") & c("approved_by").isNull())]),
        finding(vouchers.groupBy("client_id", "voucher_type", dates.fy_start(c("posting_date")).alias("fy"), "voucher_number").agg(F.count(F.lit(1)).alias("n")),
                "V-8", c("n") > 1, F.concat_ws("/", "client_id", "voucher_type", "fy", "voucher_number")),
        finding(submitted, "V-9", ~c("tax").eqNullSafe(c("recomputed")), c("voucher_id")),
        finding(documents.groupBy("client_id", "party_id", "amount", "document_date", "reference").agg(F.count(F.lit(1)).alias("n")),
                "V-13", c("n") > 1, F.concat_ws("/", "client_id", "party_id", "reference")),
    ])


def validate_invoices(sales: DataFrame) -> DataFrame:
    c = F.col
    reg = ~c("gst_category").isin("unregistered", "overseas")
    original = sales.filter("NOT is_return").select(c("ok").alias("_ok"), c("sk").alias("_sk"), c("grand_total").alias("_orig"))
    d = sales.join(original, c("is_return") & (c("ok") == c("_ok")) & (c("sk") == c("_sk")), "left")
    return findings(d, c("voucher_id"), [
        ("SI-1", reg & gstin.gstin_reason(c("party_gstin")).isNotNull()),
        ("SI-2", gstin.gstin_reason(c("supplier_gstin")).isNotNull()),
        ("SI-3", reg & c("party_gstin").isNull()),
        ("SI-4", ~gstin.state_valid(c("place_of_supply"))),
        ("SI-6", (c("cgst") > 0) & (c("igst") > 0)),
        ("SI-11", (c("gst_category") == "registered_composition") & (c("cgst") + c("igst") > 0)),
        ("SI-12", c("is_export") & c("export_type").isNull()),
        ("SI-13", c("is_return") & c("_orig").isNull()),
        ("SI-14", c("is_return") & (c("grand_total") > c("_orig"))),
    ])


def validate_bills(bills: DataFrame, status: DataFrame) -> DataFrame:
    c = F.col
    dup = bills.groupBy("client_id", "party_id", dates.fy_start(c("bill_date")).alias("fy"), "bill_number").agg(
        F.count(F.lit(1)).alias("n"))
    missing = status.filter("status = 'missing_in_2b'").select(c("voucher_id").alias("_missing")).distinct()
    d = bills.join(missing, c("voucher_id") == c("_missing"), "left")
    return _union([
        findings(d, c("voucher_id"), [
            ("PB-1", c("supplier_gstin").isNotNull() & gstin.gstin_reason(c("supplier_gstin")).isNotNull()),
            ("PB-4", (c("stated_cgst") != c("cgst")) | (c("stated_igst") != c("igst"))),
            ("PB-6", ~gstin.state_valid(c("place_of_supply"))),
            ("PB-7", c("itc_eligibility") == "mixed"),
            ("PB-8", (c("itc_claimable") > 0) & c("_missing").isNotNull()),
            ("PB-12", (c("created_via") == "ai_proposal") & c("approved_by").isNull())]),
        finding(dup, "PB-2", c("n") > 1, F.concat_ws("/", "party_id", "bill_number")),
    ])


def validate_matches(matches: DataFrame, lines: DataFrame) -> DataFrame:
    c = F.col
    live = matches.filter("unmatched_on IS NULL")
    line = lines.select("line_id", c("client_id").alias("_client"), (c("debit") + c("credit")).cast(MONEY).alias("_line"))
    per = live.groupBy("line_id").agg(F.sum("amount").cast(MONEY).alias("_sum")).join(line, "line_id")
    own = live.join(line, "line_id")
    key = c("match_id")
    return _union([
        finding(per, "BV-5", c("_sum") > c("_line"), c("line_id")),
        finding(own, "BV-6", c("client_id") != c("_client"), key),
        finding(live, "BV-9", c("ambiguous") & (c("match_type") != "manual"), key),
        finding(live, "BV-11", (c("match_type") == "ai_proposed") & c("approved_by").isNull(), key),
    ])


def validate_parties(parties: DataFrame) -> DataFrame:
    """All rules in one pass: a filter per rule would carry the expression that makes the number into each place that reads it."""
    c = F.col
    reg = ~c("gst_category").isin("unregistered", "overseas")
    return findings(parties, c("party_id"), [
        ("DIM-GSTIN", reg == c("gstin").isNull()),
        ("DIM-CHECK", c("gstin").isNotNull() & gstin.gstin_reason(c("gstin")).isNotNull()),
        ("DIM-STATE", c("gstin").isNotNull() & (gstin.state_of(c("gstin")) != c("state_code"))),
    ])


def validate_registrations(parties: DataFrame, clients: DataFrame) -> DataFrame:
    """A registration number is one party's of a client and one client's of a firm, and a client's names the client's state.

    Numbers are dealt by client and number; what is shared is reported by both.
    """
    c = F.col

    def shared(df: DataFrame, owner: str) -> DataFrame:
        return finding(df.filter("gstin IS NOT NULL").groupBy(owner, "gstin").agg(F.count(F.lit(1)).alias("n")), "DIM-UNIQUE", c("n") > 1, F.concat_ws("/", owner, "gstin"))

    return _union([shared(parties, "nation"), shared(clients, "firm_id"), findings(clients, c("client_id").cast("string"), [
        ("DIM-GSTIN", c("gstin").isNull()), ("DIM-CHECK", c("gstin").isNotNull() & gstin.gstin_reason(c("gstin")).isNotNull()),
        ("DIM-STATE", c("gstin").isNotNull() & (gstin.state_of(c("gstin")) != c("state_code")))])])


def validate_chart(chart: DataFrame) -> DataFrame:
    """Expense accounts and no others have an expense class, accounts of the balance sheet's two sides and no others a liquidity class."""
    c = F.col
    return findings(chart, c("account_code").cast("string"), [
        ("DIM-EXPENSE", (c("root_type") == "expense") != c("expense_class").isNotNull()),
        ("DIM-LIQUIDITY", c("root_type").isin("asset", "liability") != c("liquidity_class").isNotNull())])


def validate_ranges(masters: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows of dated masters, {name: (rows, key column)}, that end before they begin."""
    return _union([finding(df, "DIM-RANGE", F.col("effective_to") < F.col("effective_from"), F.concat_ws("/", F.lit(name), key)) for name, (df, key) in masters.items()])


def validate_dims(parties: DataFrame, clients: DataFrame, chart: DataFrame, masters: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """All rules of the dimensions: parties, registrations, chart and dated masters."""
    return _union([validate_parties(parties), validate_registrations(parties, clients), validate_chart(chart), validate_ranges(masters)])


# ---- vendors and duplicates ----------------------------------------------------------------------
def vendor_account_prior(parts: DataFrame, last_n: int = 5) -> DataFrame:
    """Account used on the last bills of each vendor of a client when at least three agree."""
    w = W.partitionBy("client_id", "party_id").orderBy(F.col("bill_date").desc(), F.col("ok").desc(), F.col("sk").desc(),
                                                       F.col("expense_account"))
    recent = parts.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last_n)
    g = recent.groupBy("client_id", "party_id", "expense_account").agg(F.count(F.lit(1)).alias("priors"))
    return g.filter("priors >= 3")


def duplicate_documents(docs: DataFrame) -> DataFrame:
    """Files whose full content was stored before: one row per content hash seen more than once."""
    g = docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
    return g.filter("copies > 1")


def duplicate_bills(bills: DataFrame) -> DataFrame:
    """One row per client, vendor, normalised number and amount that more than one bill has, with the first of them."""
    g = bills.groupBy("client_id", "party_id", text.norm_invoice_no(F.col("bill_number")).alias("number"), "grand_total").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("bill_date", "voucher_id")).alias("_f"))
    return g.filter("copies > 1").select("client_id", "party_id", "number", "grand_total", "copies", F.col("_f.voucher_id").alias("first_voucher"))
