"""Streaming jobs driven to completion over small files."""
from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from rokad.streaming import jobs


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_cash_alert(spark, tmp_path):
    schema = "account_id long, day date, debit decimal(18,2), credit decimal(18,2)"
    rows = [(1, date(2026, 5, 1), D(0), D(100)), (1, date(2026, 5, 2), D(150), D(0)), (1, date(2026, 5, 3), D(10), D(0)), (2, date(2026, 5, 1), D(0), D(5))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    got = _run(spark, jobs.cash_alert(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "alerts")
    assert [(r["account_id"], r["day"].day, r["balance"]) for r in got] == [(1, 2, D("-50.00"))]


def test_dedup_by_hash(spark, tmp_path):
    df = spark.range(6).select((F.col("id") % 2).alias("account_id"), F.lit("h").alias("content_hash"), F.lit("2026-05-01").cast("timestamp").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert len(_run(spark, jobs.bank_lines(s), "lines")) == 2


def _feed(spark, folder, schema, batches):
    """One file per batch, read one at a time in order."""
    import os
    import time
    for i, rows in enumerate(batches):
        out = folder / f"b{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(out))
        part = next(p for p in os.listdir(out) if p.endswith(".parquet"))
        (folder / "in").mkdir(exist_ok=True)
        os.rename(out / part, folder / "in" / f"{i:03}.parquet")
        os.utime(folder / "in" / f"{i:03}.parquet", (time.time() + i, time.time() + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


MOVES = "account_id long, day date, debit decimal(18,2), credit decimal(18,2)"


def test_cash_alert_late_line_corrects_and_withdraws(spark, tmp_path):
    d = lambda n: date(2026, 5, n)
    batches = [[(1, d(1), D(0), D(100))], [(1, d(2), D(150), D(0)), (1, d(3), D(0), D(5))], [(1, d(2), D(10), D(0))], [(1, d(1), D(0), D(500))],
               [(1, d(4), D(600), D(0))], [(1, d(5), D(1), D(0))], [(1, d(20), D(0), D(1))], [(1, d(21), D(0), D(1000))], [(1, d(22), D(0), D(1))]]
    stream = jobs.cash_alert(_feed(spark, tmp_path, MOVES, batches), "4 days")
    got = [(r["day"].day, r["balance"], r["kind"]) for r in _run(spark, stream, "late_alerts")]
    assert got == [(2, D("-50.00"), "alert"), (2, D("-60.00"), "correction"), (2, D("-60.00"), "withdrawn"), (4, D("-155.00"), "alert")]


def test_cash_alert_equals_plain_rule_in_any_order(spark, tmp_path):
    """Days of many accounts, shuffled within the delay: the alerts that stand are those of the sorted days."""
    import random
    rnd = random.Random(4)
    days = [(a, date(2026, 1, 1 + i), D(rnd.randint(0, 300)), D(rnd.randint(0, 290))) for a in range(5) for i in range(25)]
    rows = sorted(days, key=lambda r: (r[1].day + rnd.randint(0, 4), rnd.random()))
    batches = [rows[i: i + 10] for i in range(0, len(rows), 10)] + [[(9, date(2026, 3, 1), D(0), D(1))], [(9, date(2026, 3, 2), D(0), D(1))]]
    stands = {}
    for r in _run(spark, jobs.cash_alert(_feed(spark, tmp_path, MOVES, batches), "10 days"), "any_order"):
        if r["kind"] == "withdrawn":
            del stands[r["account_id"], r["day"]]
        else:
            stands[r["account_id"], r["day"]] = r["balance"]
    want = {}
    for a in range(5):
        balance, below = D(0), False
        for _, day, debit, credit in sorted(r for r in days if r[0] == a):
            balance += credit - debit
            if balance < 0 and not below:
                want[a, day] = balance
            below = balance < 0
    assert stands == want and len(want) > 5


def test_chain_verify_out_of_order_and_missing(spark, tmp_path):
    from datetime import datetime, timedelta
    from rokad.functions.audit import GENESIS
    t0 = datetime(2026, 5, 1)
    links = [(1, 0, i, t0 + timedelta(minutes=i), GENESIS if i == 1 else f"h{i - 1}", f"h{i}", "changed" if i == 3 else f"h{i}") for i in range(1, 9)]
    by_id = {r[2]: r for r in links}
    later = (2, 0, 99, t0 + timedelta(days=1), GENESIS, "x", "x")
    last = (2, 0, 100, t0 + timedelta(days=2), "x", "y", "y")
    batches = [[by_id[2], by_id[4]], [by_id[1]], [by_id[3]], [by_id[7], by_id[8]], [by_id[5], by_id[5]], [later], [last]]  # 6 never comes
    schema = "firm_id int, segment int, id long, ts timestamp, prev_hash string, row_hash string, expected string"
    got = [(r["firm_id"], r["id"], r["ok"]) for r in _run(spark, jobs.chain_verify(_feed(spark, tmp_path, schema, batches)), "chain")]
    assert got == [(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, True), (1, 5, True), (2, 99, True), (1, 7, False), (1, 8, True), (2, 100, True)]


def test_settlements_early_late_and_missing(spark, tmp_path):
    import json
    from rokad.sources.collections import read_collections, stream_collections
    feed = tmp_path / "feed"
    feed.mkdir()
    rows = [(f"c{i}", 1, 7, "R", amount, moment) for i, (amount, moment) in enumerate([
        ("10.00", "2026-05-01T08:00:00Z"), ("15.50", "2026-05-01T20:00:00Z"), ("40.00", "2026-05-02T09:00:00Z"), ("7.00", "2026-05-03T09:00:00Z"), ("1.00", "2026-06-20T09:00:00Z")])]
    names = ["collection_id", "client_id", "account_id", "reference", "amount", "collected_at"]
    (feed / "a.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows[:3]))
    (feed / "b.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in [rows[0], *rows[3:]]) + "\nnot json")
    assert read_collections(spark, str(feed)).filter("collection_id IS NOT NULL").count() == 5
    stream = stream_collections(spark, str(feed)).filter("collection_id IS NOT NULL")
    bank = "client_id int, account_id long, line_id string, credit decimal(18,2), ts timestamp"
    from datetime import datetime
    lines = [(1, 7, "early", D("25.50"), datetime(2026, 5, 1, 21)), (1, 7, "other", D("9.00"), datetime(2026, 5, 2)), (1, 7, "late", D("40.00"), datetime(2026, 5, 5, 12)),
             (1, 7, "end", D("0.01"), datetime(2026, 6, 21))]
    spark.createDataFrame(lines, bank).write.parquet(str(tmp_path / "bank"))
    joined = jobs.settlements(stream, spark.readStream.schema(bank).parquet(str(tmp_path / "bank")))
    got = {r["day"].isoformat(): (r["batch_total"], r["collections"], r["line_id"]) for r in _run(spark, joined, "settled")}
    assert got == {"2026-05-01": (D("25.50"), 2, "early"), "2026-05-02": (D("40.00"), 1, "late"), "2026-05-03": (D("7.00"), 1, None)}


def test_known_link_and_daily_movement(spark, tmp_path):
    from datetime import datetime
    schema = "line_id string, client_id int, reference string, account_id long, debit decimal(18,2), credit decimal(18,2), ts timestamp"
    batches = [[("a", 1, "R1", 5, D(0), D(10), datetime(2026, 5, 1, 3)), ("b", 1, "R9", 5, D(4), D(0), datetime(2026, 5, 1, 4))],
               [("c", 2, "R1", 5, D(0), D(1), datetime(2026, 5, 9))], [("d", 2, "R1", 6, D(0), D(1), datetime(2026, 5, 20))]]
    invoices = spark.createDataFrame([(1, "R1", date(2026, 4, 2), "V2"), (1, "R1", date(2026, 4, 1), "V1"), (1, None, date(2026, 4, 1), "V0")],
                                     "client_id int, reference string, document_date date, voucher_id string")
    stream = _feed(spark, tmp_path, schema, batches)
    assert [(r["line_id"], r["voucher_id"]) for r in _run(spark, jobs.known_link(stream, invoices), "links")] == [("a", "V1")]
    got = [(r["account_id"], r["day"].isoformat(), r["debit"], r["credit"], r["lines"]) for r in _run(spark, jobs.daily_movement(stream), "movement")]
    assert got == [(5, "2026-05-01", D("4.00"), D("10.00"), 2), (5, "2026-05-09", D("0.00"), D("1.00"), 1)]
