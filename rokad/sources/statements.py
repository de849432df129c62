"""Delimited bank statements: records, delimiter vote, header location, rows and balances.

Input is one row per physical line: (file_id, line_no, line); line_no orders the lines of a file.
"""
from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text
from ..functions.dates import date_fields, date_numbers, date_of, date_text, parse_date
from ..functions.money import MONEY, zero
from ..operators.prefix import running_sum
from ..operators.staging import stage

DELIMITERS = [",", "\t", ";", "|"]
HEADER_ROWS, VOTE_ROWS = 60, 40
ROLES = ["txn_date", "value_date", "narration", "reference", "debit", "credit", "amount", "flag", "balance"]
# Statement layouts — bank, priority, date format, convention, detection words, heading aliases.
TEMPLATES = [
    ("HDFC Bank", 90, "dd/MM/yy", "separate", ["hdfc"], dict(
        txn_date=["date"], value_date=["value dt", "value date"], narration=["narration"],
        reference=["chq./ref.no", "chq/ref", "ref.no", "reference"], debit=["withdrawal amt", "withdrawal"],
        credit=["deposit amt", "deposit"], balance=["closing balance", "balance"])),
    ("ICICI Bank", 90, "dd/MM/yyyy", "separate", ["icici"], dict(
        txn_date=["transaction date", "txn date"], value_date=["value date"],
        narration=["transaction remarks", "remarks", "description"], reference=["cheque number", "cheque no"],
        debit=["withdrawal amount", "withdrawal"], credit=["deposit amount", "deposit"], balance=["balance"])),
    ("State Bank of India", 90, "dd/MM/yyyy", "separate", ["state bank of india", "sbi"], dict(
        txn_date=["txn date", "transaction date", "date"], value_date=["value date"],
        narration=["details", "description", "particulars", "narration"],
        reference=["ref no/cheque no", "ref no./cheque no", "ref no", "cheque no"], debit=["debit"], credit=["credit"],
        balance=["balance"])),
    ("Axis Bank", 90, "dd-MM-yyyy", "separate", ["axis"], dict(
        txn_date=["tran date", "transaction date"], value_date=["value date"], narration=["particulars"],
        reference=["chqno", "chq no", "cheque"], debit=["dr", "debit"], credit=["cr", "credit"], balance=["bal", "balance"])),
    ("Kotak Mahindra Bank", 90, "dd-MM-yyyy", "flagged", ["kotak"], dict(
        txn_date=["transaction date", "date"], value_date=["value date"], narration=["description", "narration"],
        reference=["chq / ref no", "ref no", "cheque"], amount=["amount"], flag=["dr / cr", "dr/cr", "type"], balance=["balance"])),
    ("Federal Bank", 85, "dd-MMM-yyyy", "separate", ["federal bank", "fdrl"], dict(
        txn_date=["date"], value_date=["value date"], narration=["particulars"], reference=["cheque details", "cheque"],
        debit=["withdrawals", "withdrawal"], credit=["deposits", "deposit"], flag=["tran type", "type"], balance=["balance"])),
    ("IndusInd Bank", 85, "dd-MMM-yyyy", "separate", ["indusind"], dict(
        txn_date=["date"], narration=["particulars"], reference=["chq./ref. no", "chq/ref", "ref. no"], debit=["withdrawal"],
        credit=["deposit"], balance=["balance"])),
    ("Karur Vysya Bank", 85, "dd/MM/yyyy", "separate", ["karur vysya", "kvb"], dict(
        txn_date=["txn date", "date"], value_date=["value date"], narration=["particulars"], reference=["ref no", "ref. no"],
        debit=["debit"], credit=["credit"], balance=["balance"])),
    ("Bank of Baroda", 85, "dd-MM-yyyy", "separate", ["bank of baroda", "bob world", "barb0"], dict(
        txn_date=["transaction date", "txn date"], value_date=["value date"], narration=["description"],
        reference=["cheque number", "cheque no"], debit=["debit"], credit=["credit"], balance=["balance"])),
    ("Generic (separate debit/credit columns)", 10, "dd/MM/yyyy", "separate", [], dict(
        txn_date=["txn date", "transaction date", "tran date", "date"], value_date=["value date", "value dt"],
        narration=["narration", "description", "particulars", "remarks", "details"], reference=["ref", "cheque", "chq", "utr"],
        debit=["withdrawal", "debit", "dr amount", "paid out", "dr"], credit=["deposit", "credit", "cr amount", "paid in", "cr"],
        balance=["closing balance", "running balance", "balance", "bal"])),
    ("Generic (single signed amount column)", 5, "dd/MM/yyyy", "signed", [], dict(
        txn_date=["txn date", "transaction date", "date"], narration=["narration", "description", "particulars", "remarks"],
        reference=["ref", "cheque", "utr"], amount=["amount", "transaction amount"], balance=["balance", "bal"])),
]
OPENING = ["opening balance", "opening bal", "balance b/f", "brought forward"]
CLOSING = ["closing balance", "closing bal", "balance c/f", "carried forward"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines of every file under a path; a statement file is small, a folder is not."""
    t = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file_id"), "value")
    body = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n")
    return t.select("file_id", F.posexplode(F.split(body, "\n")).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("long"))


def records(lines: DataFrame, span: int = 4096) -> DataFrame:
    """Logical records: a line with an open quote runs on into the next ones. Blank records are dropped."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    d = lines.withColumn("_q", quotes).withColumn("_chunk", F.floor(F.col("line_no") / span))
    # staged, so that its size is known: in a folder with few or none of them the joins below shuffle nothing
    split = stage(d.filter("_q % 2 = 1").select("file_id").distinct())
    plain = d.join(split, "file_id", "left_anti").select("file_id", "line_no", "line")
    d = d.join(split, "file_id", "left_semi")
    d = running_sum(d, ["file_id"], ["_chunk"], ["line_no"], {"_run": F.col("_q").cast("long")}, "long")
    d = d.withColumn("_start", ((F.col("_run") - F.col("_q")) % 2 == 0).cast("long"))
    d = running_sum(d, ["file_id"], ["_chunk"], ["line_no"], {"_rec": F.col("_start")}, "long")
    joined = d.groupBy("file_id", "_rec").agg(
        F.min("line_no").alias("line_no"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    whole = joined.select("file_id", "line_no", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("line"))
    return plain.unionByName(stage(whole)).filter(F.trim("line") != "")


def split_cells(line: Column, delimiter: str) -> Column:
    """Cells of a record; delimiters inside quotes do not count, doubled quotes are literal."""
    # one pass: between quotes, every second part is inside; only delimiters of the others cut
    marked = F.transform(F.split(line, '"'), lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit(delimiter), F.lit("\x01"))).otherwise(x))
    parts = F.split(F.array_join(marked, '"'), "\x01")

    def clean(x: Column) -> Column:
        t = F.trim(x)
        inner = F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))
        return F.trim(F.when(t.startswith('"') & t.rlike('(?s)^".*"$') & (F.length(t) > 1), inner).otherwise(F.replace(t, F.lit('"'), F.lit(""))))
    return F.transform(parts, clean)


def _widths(line: Column) -> list[Column]:
    """Number of cells under each delimiter, without making them."""
    bare = F.regexp_replace(line, '"[^"]*(?:"|\\z)', "")

    def times(x: Column, mark: str) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))
    return [(times(bare, d) + times(line, "\x01") + 1).cast("int") for d in DELIMITERS]


def _first_rows(df: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("file_id").orderBy("line_no")
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)


def delimiters(recs: DataFrame) -> DataFrame:
    """Delimiter of each file: agreement on a column count first, then the count itself."""
    # widths are counted before the rows are shuffled, so no text moves
    head = _first_rows(recs.select("file_id", "line_no", *[w.alias(f"_w{i}") for i, w in enumerate(_widths(F.col("line")))]), VOTE_ROWS)
    counts = head.select("file_id", "_n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("d"), F.col(f"_w{i}").alias("n")) for i in range(len(DELIMITERS))])).alias("v"))
    # a single column is no vote; the first delimiter's rows stay for files without any
    agree = counts.filter("v.n > 1 OR v.d = 0").groupBy("file_id", "v.d", "v.n").agg(F.count(F.lit(1)).alias("agree"), F.min("_n").alias("first"))
    votes = F.col("n") > 1
    modal = agree.groupBy("file_id", "d").agg(F.max_by(F.when(votes, F.struct("agree", "n")), F.when(votes, F.struct("agree", -F.col("first")))).alias("m"))
    best = F.max_by("d", F.when(F.col("m").isNotNull(), F.struct(F.col("m.agree") * 10 + F.col("m.n"), -F.col("d"))))
    return modal.groupBy("file_id").agg(F.coalesce(best, F.lit(0)).alias("delimiter_no"))


def cells(recs: DataFrame, delims: DataFrame) -> DataFrame:
    j = recs.join(delims, "file_id")
    out = split_cells(F.col("line"), DELIMITERS[0])
    for i, d in enumerate(DELIMITERS[1:], 1):
        out = F.when(F.col("delimiter_no") == i, split_cells(F.col("line"), d)).otherwise(out)
    return j.select("file_id", "line_no", out.alias("cells"))


def _norm(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def _pattern(alias: str) -> str:
    return "(?:^|[^a-z0-9])" + "".join("\\" + ch if ch in ".*+?^${}()|[]\\/" else ch for ch in alias) + "(?:[^a-z0-9]|$)"


def _any_alias(role: str) -> str:
    """Pattern of lower-case text in which some layout's heading for a role may stand; spaces are not yet collapsed."""
    aliases = sorted({a for t in TEMPLATES for a in t[5].get(role, [])})
    return "(?:^|[^a-z0-9])(?:" + "|".join(re.escape(a).replace("\\ ", r"\s+") for a in aliases) + ")(?:[^a-z0-9]|$)"


def headers(grid: DataFrame) -> DataFrame:
    """Header row, layout and column positions of each file: named bank, then priority, then mapped columns."""
    body = [dict(bank=b, priority=p, fmt=f, convention=c, detect=d, order=i,
                 **{r: [_pattern(a) for a in sorted(cols.get(r, []), key=len, reverse=True)] for r in ROLES})
            for i, (b, p, f, c, d, cols) in enumerate(TEMPLATES)]
    kind = ("array<struct<bank:string,priority:int,fmt:string,convention:string,detect:array<string>,order:int,"
            + ",".join(f"{r}:array<string>" for r in ROLES) + ">>")
    # one pass over the first rows: the text in which banks are looked for, and the few rows that name a date and a narration column
    head = _first_rows(grid, HEADER_ROWS).withColumn("_text", F.array_join("cells", " "))
    low = F.lower("_text")
    maybe = (F.size("cells") >= 3) & low.rlike(_any_alias("txn_date")) & low.rlike(_any_alias("narration"))
    files = head.groupBy("file_id").agg(
        F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "_text"))), lambda x: x["_text"]), " ")).alias("hay"),
        F.collect_list(F.when(maybe, F.struct("line_no", "_n", "cells"))).alias("_rows"))
    words = sorted({w for t in TEMPLATES for w in t[4]})
    found = F.array_compact(F.array(*[F.when(F.col("hay").contains(w), w) for w in words]))
    rows = files.filter(F.size("_rows") > 0).select("file_id", found.alias("found"), F.explode("_rows").alias("r")).select("file_id", "found", "r.*")
    numeric = F.size(F.filter("cells", text.looks_numeric))
    rows = stage(rows.filter(numeric <= 1).select("file_id", "found", "line_no", "_n", F.transform("cells", _norm).alias("h")))
    # files share their headings: layouts are tried once for each different row
    t = rows.select("h").distinct().select("h", F.explode(F.from_json(F.lit(json.dumps(body)), kind)).alias("t"))

    def position(role: str) -> Column:
        hits = F.transform(F.col(f"t.{role}"), lambda a: F.array_position(F.transform("h", lambda x: F.rlike(x, a)), F.lit(True)))
        return (F.get(F.filter(hits, lambda n: n > 0), F.lit(0)) - 1).cast("int")

    t = t.select("h", "t", *[position(r).alias(f"c_{r}") for r in ROLES])
    has = (
        F.when(F.col("t.convention") == "separate", F.col("c_debit").isNotNull() | F.col("c_credit").isNotNull())
        .when(F.col("t.convention") == "flagged", F.col("c_amount").isNotNull() & F.col("c_flag").isNotNull())
        .otherwise(F.col("c_amount").isNotNull()))
    # staged first: a filter on positions would be pushed down and write their expressions out again
    t = stage(t).filter(has & F.col("c_txn_date").isNotNull() & F.col("c_narration").isNotNull())
    t = rows.join(t.withColumn("t", F.struct(*[F.col(f"t.{x}").alias(x) for x in ("bank", "priority", "fmt", "convention", "detect", "order")])), "h").drop("h")
    named = F.arrays_overlap("t.detect", "found")
    mapped = sum((F.col(f"c_{r}").isNotNull().cast("int") for r in ROLES), F.lit(0))
    t = t.withColumn("score", F.when(named, 100000).otherwise(0) + F.col("t.priority") * 100 + mapped)
    w = W.partitionBy("file_id").orderBy(F.col("score").desc(), "_n", F.when(named, 0).otherwise(1), "t.order")
    return t.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
        "file_id", F.col("line_no").alias("header_line"), F.col("t.bank").alias("bank"), F.col("t.fmt").alias("fmt"),
        "score", *[f"c_{r}" for r in ROLES])


def build_rows(grid: DataFrame, heads: DataFrame, printed_zero: bool = False) -> DataFrame:
    """Rows under the header with parsed date and money, and why a row is not a transaction.

    printed_zero: a zero that is printed is a transaction of zero, and only a date without any amount is none.
    """
    d = grid.join(heads, "file_id").filter("line_no > header_line")

    def cell(role: str) -> Column:
        return F.coalesce(F.get("cells", F.col(f"c_{role}")), F.lit(""))

    # every step of a parsed cell is a column of its own, which later ones pick from: it is compiled and runs once, where a lambda's runs at each use
    days, sums = ("txn_date", "value_date"), ("debit", "credit", "amount", "balance")
    d = d.withColumns({f"_t_{r}": cell(r) for r in (*days, *sums)})
    d = d.withColumns({f"_t_{r}": date_text(F.col(f"_t_{r}")) for r in days} | {f"_{k}_{r}": x for r in sums for k, x in text.amount_parts(F.col(f"_t_{r}")).items()})
    d = d.withColumns({f"_{i}_{r}": x for r in days for i, x in enumerate(date_fields(F.col(f"_t_{r}")))}
                      | {f"_p_{r}": text.amount_of(*[F.col(f"_{k}_{r}") for k in ("blank", "paren", "marker", "body")]) for r in sums})
    d = d.withColumns({f"_{i}_{r}": x for r in days for i, x in enumerate(date_numbers(*[F.col(f"_{i}_{r}") for i in range(3)], F.col("fmt")))})
    d = d.withColumns({r: date_of(*[F.col(f"_{i}_{r}") for i in range(3)]) for r in days})
    debit, credit, amount, balance = (F.col(f"_p_{r}") for r in sums)
    separate = F.col("c_debit").isNotNull() | F.col("c_credit").isNotNull()
    flagged = ~separate & F.col("c_flag").isNotNull()
    mark = F.substring(F.lower(F.trim(cell("flag"))), 1, 1)
    out = F.when(separate, debit["value"]).when(flagged, F.when(mark == "d", amount["value"])).when(amount["negative"], amount["value"])
    inn = F.when(separate, credit["value"]).when(flagged, F.when(mark == "c", amount["value"])).when(~amount["negative"], amount["value"])
    d = d.withColumn("debit", F.coalesce(out, zero()).cast(MONEY)).withColumn("credit", F.coalesce(inn, zero()).cast(MONEY))
    stated = [x["valid"] & ~x["blank"] for x in (debit, credit, amount)]
    kept = F.when(separate, stated[0] | stated[1]).otherwise(stated[2]) if printed_zero else F.lit(False)
    reason = (
        F.when(F.col("txn_date").isNull(), "no parsable date in the date column")
        .when(flagged & ~mark.isin("d", "c"), "amount has no Dr/Cr marker")
        .when(~kept & (F.col("debit") == 0) & (F.col("credit") == 0), "zero amount on both sides"))
    narration = F.when(cell("narration") == "", "(no narration)").otherwise(cell("narration"))
    return d.select(
        "file_id", "line_no", "txn_date", "value_date",
        narration.alias("narration"), "debit", "credit", text.signed(balance).alias("running_balance"),
        reason.alias("reason"), F.array_join("cells", " | ").alias("text"))


#: A whole number that alone follows a label in its cell; a date there, or words, are none.
WHOLE = r"^[\s:=\-]*(?:rs\.?|inr|₹)?\s*(\d[\d,]*)\s*$"
#: Rows below a label's own in which its value may stand.
BENEATH = 2


def _label_hits(around: DataFrame) -> DataFrame:
    """A row for every balance label that a row names: whether it is of the opening (opens), its place among them (no), and the first cell with it (col, text).

    A label that abbreviates one before it says the same in the cell of that one and is left out.
    """
    marks = [(opens, no, v, next((x for x in labels[:no] if x.startswith(v)), "")) for opens, labels in ((True, OPENING), (False, CLOSING)) for no, v in enumerate(labels)]
    known = F.array(*[F.struct(*[F.lit(x).alias(name) for x, name in zip(mark, ("opens", "no", "label", "longer"), strict=True)]) for mark in marks])
    hits = around.withColumn("_n", F.transform("cells", _norm)).select("*", F.explode(known).alias("s")).select("*", "s.*").drop("s")
    hits = hits.withColumn("col", F.array_position(F.transform("_n", lambda x: x.contains(F.col("label"))), F.lit(True)).cast("int"))
    hits = stage(hits.withColumn("text", F.get("_n", F.col("col") - 1)).drop("_n"))
    return hits.filter((F.col("col") > 0) & ((F.col("longer") == "") | ~F.col("text").contains(F.col("longer"))))


def _beneath(grid: DataFrame, wanted: DataFrame) -> DataFrame:
    """Amounts of labels that have none on their row: a summary has the label as a heading, and the value in the same column one or two rows below.

    Rows are counted above the heading of the table, or, below it, among those without a date. Only files with such a label are read.
    """
    wanted = stage(wanted.select("file_id", "line_no", "pre", "opens", "no", "col", "header_line", "fmt", "c_txn_date"))
    files = stage(wanted.select("file_id", "header_line", "fmt", "c_txn_date").distinct())
    dated = F.coalesce(F.get("cells", F.col("c_txn_date")), F.lit(""))
    rows = grid.join(files, "file_id").filter("line_no <> header_line").select(
        "file_id", "line_no", (F.col("line_no") < F.col("header_line")).alias("pre"), "cells", "fmt", dated.alias("day"))
    rows = rows.withColumn("day", parse_date(F.col("day"), F.col("fmt"))).filter("pre OR day IS NULL")
    w = W.partitionBy("file_id", "pre").orderBy("line_no")
    rows = stage(rows.select("file_id", "line_no", "pre", "cells", F.row_number().over(w).alias("n")))
    asked = wanted.join(rows.select("file_id", "line_no", "n"), ["file_id", "line_no"]).select(
        "file_id", "line_no", "pre", "opens", "no", "col", F.explode(F.sequence(F.col("n") + 1, F.col("n") + BENEATH)).alias("n"))
    met = asked.join(rows.select("file_id", "pre", "n", "cells"), ["file_id", "pre", "n"]).select(
        "file_id", "line_no", "pre", "opens", "no", "n", F.get("cells", F.col("col") - 1).alias("raw"))
    met = stage(met).withColumn("amount", text.signed_amount(F.col("raw")))
    return met.groupBy("file_id", "line_no", "pre", "opens", "no").agg(F.min_by("amount", F.when(F.col("amount").isNotNull(), F.col("n"))).alias("amount"))


def balances(grid: DataFrame, rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Opening and closing: a label in the preamble or trailer, a carried row, else from the running balances.

    A label's value stands behind it in its cell, else in the nearest cell with a number to the right, then to the left, else beneath it.
    """
    good, at = F.col("reason").isNull(), F.col("line_no")
    opening_row = F.col("txn_date").isNotNull() & ~good & F.col("running_balance").isNotNull() & F.exists(
        F.array(*[F.lit(v) for v in OPENING]), lambda v: F.lower("text").contains(v))
    # rows are read once and not filtered by what is parsed of them, since a filter that is pushed down would parse them again
    derived = rows.groupBy("file_id").agg(
        F.count_if(good).alias("n"), F.min_by((F.col("running_balance") - F.col("credit") + F.col("debit")).cast(MONEY), F.when(good, at)).alias("f"),
        F.max_by("running_balance", F.when(good, at)).alias("l"), F.min(F.when(good, F.col("txn_date"))).alias("first_date"),
        F.max(F.when(good, F.col("txn_date"))).alias("last_date"), F.min_by("running_balance", F.when(opening_row, at)).alias("r")).filter("n > 0")

    said = F.lower(F.array_join("cells", " ")).rlike("|".join(re.escape(v).replace("\\ ", r"\s+") for v in OPENING + CLOSING))
    dated = F.coalesce(F.get("cells", F.col("c_txn_date")), F.lit(""))
    around = grid.filter(said).join(heads.select("file_id", "header_line", "fmt", "c_txn_date"), "file_id").filter("line_no <> header_line")
    hits = _label_hits(around.select("file_id", "line_no", "header_line", "fmt", "c_txn_date", dated.alias("day"), "cells"))
    rest = F.substring("text", F.instr("text", F.col("label")) + F.length("label"), F.length("text"))
    # what is left of the cell behind the label, as text of a number: the cell is settled first, so the parsers read plain columns
    beside = F.coalesce(F.get(F.filter(F.slice("cells", F.col("col") + 1, F.size("cells")), text.looks_numeric), F.lit(0)),
                        F.get(F.filter(F.reverse(F.slice("cells", F.lit(1), F.col("col") - 1)), text.looks_numeric), F.lit(0)))
    raw = hits.withColumn("_rest", rest).select(
        "file_id", "line_no", (at < F.col("header_line")).alias("pre"), "header_line", "fmt", "c_txn_date", "day", "opens", "no", "col",
        F.coalesce(F.nullif(F.regexp_extract("_rest", r"([\d,]+\.\d{2})", 1), F.lit("")), F.nullif(F.regexp_extract("_rest", WHOLE, 1), F.lit("")), beside).alias("raw"))
    lab = stage(stage(raw).withColumn("day", parse_date(F.col("day"), F.col("fmt"))).withColumn("amount", text.signed_amount(F.col("raw"))).filter("pre OR day IS NULL"))
    mined = lab.select("file_id", "line_no", "pre", "opens", "no", "amount").unionByName(_beneath(grid, lab.filter("amount IS NULL")))

    def pick(opens: bool) -> Column:
        """The first amount by row, then by label: an opening one above the table before one below it, a closing one the other way."""
        usable = F.col("amount").isNotNull() & (F.col("opens") == opens)
        return F.coalesce(*[F.min_by("amount", F.when(usable & (F.col("pre") == side), F.struct("line_no", "no"))) for side in (opens, not opens)])
    m = mined.groupBy("file_id").agg(pick(True).alias("o"), pick(False).alias("c"))
    return derived.join(m, "file_id", "left").select(
        "file_id", F.coalesce("o", "r", "f").alias("opening_balance"), F.coalesce("c", "l").alias("closing_balance"), "first_date", "last_date")


def periods(grid: DataFrame, heads: DataFrame, bals: DataFrame) -> DataFrame:
    """Statement period: two dates on a preamble row that speaks of a period, else first and last transaction."""
    joined = F.array_join("cells", " ")
    pre = grid.join(heads.select("file_id", "header_line", "fmt"), "file_id").filter("line_no < header_line").filter(
        joined.rlike(r"(?i)period|statement\s+(from|for)|\bfrom\s*:?\s*\d"))
    found = F.regexp_extract_all(joined, F.lit(r"(\d{1,4}[/\-. ]\w{2,4}[/\-. ]\d{2,4})"), F.lit(1))
    # one row per date, staged as text, so that the parser reads a plain column; then the first row of a file with two dates or more
    raw = stage(pre.select("file_id", "line_no", "fmt", F.posexplode(found).alias("at", "x")))
    days = raw.select("file_id", "line_no", "at", parse_date(F.col("x"), F.col("fmt")).alias("day"))
    known = F.when(F.col("day").isNotNull(), F.col("at"))
    rows = days.groupBy("file_id", "line_no").agg(F.count("day").alias("n"), F.min_by("day", known).alias("from"), F.max_by("day", known).alias("to"))
    two = F.when(F.col("n") >= 2, F.col("line_no"))
    p = rows.groupBy("file_id").agg(F.min_by("from", two).alias("from"), F.min_by("to", two).alias("to"))
    return bals.join(p, "file_id", "left").select(
        "file_id", F.coalesce("from", "first_date").alias("period_from"), F.coalesce("to", "last_date").alias("period_to"))


def profile_columns(grid: DataFrame) -> DataFrame:
    """Share of dates, numbers and blanks and the longest text of every column of a file."""
    c = grid.select("file_id", F.posexplode("cells").alias("col", "cell"))
    cell = F.col("cell")
    blank = (F.trim(cell) == "") | (F.trim(cell) == "-")
    date = cell.rlike(r"^\s*\d{1,4}[/\-. ](\d{1,2}|[A-Za-z]{3,4})[/\-. ]\d{1,4}")
    g = c.groupBy("file_id", "col").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("blanks"), F.count_if(~blank & date).alias("dates"),
        F.count_if(~blank & ~date & text.looks_numeric(cell)).alias("numbers"), F.max(F.length(cell)).alias("max_length"))
    full = F.greatest(F.col("n") - F.col("blanks"), F.lit(1))
    return g.select("file_id", "col", (F.col("dates") / full).alias("date_fraction"), (F.col("numbers") / full).alias("numeric_fraction"),
                    (F.col("blanks") / F.col("n")).alias("blank_fraction"), "max_length")


def infer_money_columns(grid: DataFrame, profile: DataFrame) -> DataFrame:
    """Balance, debit and credit columns that best reproduce the row-to-row balance changes (2 agreements or more).

    Only numeric columns are tried (a statement has a handful), and scores are counts per file.
    """
    usable = profile.filter("numeric_fraction >= 0.7 AND date_fraction < 0.8").groupBy("file_id").agg(
        F.sort_array(F.collect_list("col")).alias("u"))
    tries = usable.select("file_id", F.explode("u").alias("b"), "u").select(
        "file_id", "b", F.explode(F.filter("u", lambda x: x != F.col("b"))).alias("d"), "u").select(
        "file_id", "b", "d", F.explode(F.filter("u", lambda x: x != F.col("b"))).alias("c"))
    rows = grid.select("file_id", "line_no", F.transform("cells", text.signed_amount).alias("v"))
    bal = rows.join(tries.select("file_id", "b").distinct(), "file_id").withColumn("now", F.get("v", F.col("b"))).filter("now IS NOT NULL")
    w = W.partitionBy("file_id", "b").orderBy("line_no")
    moves = bal.withColumn("step", F.col("now") - F.lag("now").over(w)).filter("step IS NOT NULL")
    j = moves.join(tries, ["file_id", "b"])
    dv, cv = F.get("v", F.col("d")), F.get("v", F.col("c"))
    single = F.col("d") == F.col("c")
    known = dv.isNotNull() | cv.isNotNull()
    fits = F.when(single, F.abs("step") == F.abs(dv)).otherwise(F.col("step") == F.coalesce(cv, zero()) - F.coalesce(dv, zero()))
    s = j.filter(known).groupBy("file_id", "b", "d", "c").agg(F.count_if(fits).alias("agreed"), F.count_if(~fits).alias("disagreed"))
    rank = F.struct(F.col("agreed") - F.col("disagreed"), F.when(F.col("d") == F.col("c"), 0).otherwise(1), -F.col("b"), -F.col("d"), -F.col("c"))
    best = s.filter("agreed >= 2").groupBy("file_id").agg(F.max_by(F.struct("b", "d", "c", "agreed", "disagreed"), rank).alias("x"))
    one = F.col("x.d") == F.col("x.c")
    return best.select("file_id", F.col("x.b").alias("balance"), F.when(~one, F.col("x.d")).alias("debit"), F.when(~one, F.col("x.c")).alias(
        "credit"), F.when(one, F.col("x.d")).alias("amount"), F.col("x.agreed").alias("agreed"), F.col("x.disagreed").alias("disagreed"))


def group_continuations(grid: DataFrame, forward: list[str] | None = None, span: int = 4096) -> DataFrame:
    """Wrapped lines joined to the dated row above, or to the one below when they open with a forward marker."""
    start = F.coalesce(F.get("cells", F.lit(0)).rlike(r"^\d{1,4}[/\-. ](\d{1,2}|[A-Za-z]{3,4})[/\-. ]\d{1,4}"), F.lit(False))
    joined = F.upper(F.trim(F.array_join("cells", " ")))
    down = F.lit(False)
    for mark in forward or []:
        down = down | joined.startswith(mark.upper())
    d = grid.withColumn("_chunk", F.floor(F.col("line_no") / span)).withColumn("_s", start).withColumn("_down", ~start & down)
    d = running_sum(d, ["file_id"], ["_chunk"], ["line_no"], {"_g": F.col("_s").cast("long")}, "long")
    d = d.withColumn("group_no", F.col("_g") + F.col("_down").cast("long")).filter("group_no > 0")
    body = F.array_join(F.filter("cells", lambda x: x != ""), "")
    return d.groupBy("file_id", "group_no").agg(
        F.min(F.when(F.col("_s"), F.col("line_no"))).alias("line_no"), F.count_if(~F.col("_s")).alias("continuations"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("_s"), F.struct("line_no", body.alias("t"))))), lambda x: x["t"]), "").alias("extra"))
