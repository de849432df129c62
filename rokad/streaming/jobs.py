"""Streaming jobs.

Each takes a streaming DataFrame with an event time and returns a streaming DataFrame, or starts a
query with foreachBatch where history has to be consulted. State is kept per account or firm and
holds a few values, never the rows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, datetime, time, timedelta, timezone
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.audit import GENESIS


def bank_lines(lines: DataFrame, delay: str = "2 days") -> DataFrame:
    """Arriving lines, each content hash of an account once inside the watermark."""
    return lines.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["account_id", "content_hash"])


def append_batch(read_known: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: what is older than the watermark is still caught against the stored lines."""
    def run(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["account_id", "content_hash"]).join(
            read_known().select("account_id", "content_hash"), ["account_id", "content_hash"], "left_anti")
        write(fresh)
    return run


def known_link(collections: DataFrame, open_invoices: DataFrame) -> DataFrame:
    """Collections joined to the invoice that announced their reference (stream-static join)."""
    first = open_invoices.filter("reference IS NOT NULL").groupBy("client_id", "reference").agg(
        F.min(F.struct("document_date", "voucher_id")).alias("_d"))
    return collections.join(first, ["client_id", "reference"]).select(
        "line_id", "client_id", "reference", F.col("_d.voucher_id").alias("voucher_id"))


def daily_movement(lines: DataFrame, delay: str = "2 days") -> DataFrame:
    """Debits and credits per account and day, final once the watermark passes the day."""
    return lines.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "account_id").agg(
        F.sum("debit").cast("decimal(18,2)").alias("debit"), F.sum("credit").cast("decimal(18,2)").alias("credit"),
        F.count(F.lit(1)).alias("lines")).select(
        "account_id", F.col("window.start").cast("date").alias("day"), "debit", "credit", "lines")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """transformWithState by event time; its state variables need the RocksDB store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime")


def _millis(moment: datetime) -> int:
    return int(moment.replace(tzinfo=timezone.utc).timestamp() * 1000)


ALERT = "account_id long, day date, balance decimal(18,2), kind string"


class CashAlert(StatefulProcessor):
    """First day of each stretch of days that close below zero, per account.

    State: movement of each open day, the balance before them, and what was said about them. A day is judged as soon as a later one has lines. A
    late line opens its day again: a changed balance is sent as a correction, a stretch that is no more as withdrawn. The
    timer at a day's end fires once the watermark has passed it: the day is judged for good and folded into the balance before.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.before = handle.getValueState("before", "balance decimal(18,2), below boolean")
        self.days = handle.getMapState("days", "day date", "movement decimal(18,2)")
        self.sent = handle.getMapState("sent", "day date", "balance decimal(18,2)")

    def _judge(self, account: int, held: dict[date, Decimal], until: date) -> pd.DataFrame:
        """What is to be said about the held days before a day, beside what was said before."""
        balance, below = self.before.get() if self.before.exists() else (Decimal("0.00"), False)
        starts: dict[date, Decimal] = {}
        for day in sorted(d for d in held if d < until):
            balance += held[day]
            if balance < 0 and not below:
                starts[day] = balance
            below = balance < 0
        said = {k[0]: v[0] for k, v in self.sent.iterator()}
        out = [(account, d, b, "correction" if d in said else "alert") for d, b in sorted(starts.items()) if said.get(d) != b]
        out += [(account, d, said[d], "withdrawn") for d in sorted(said.keys() - starts.keys()) if d < until]
        for _, day, amount, kind in out:
            if kind == "withdrawn":
                self.sent.removeKey((day,))
            else:
                self.sent.updateValue((day,), (amount,))
        return pd.DataFrame(out, columns=["account_id", "day", "balance", "kind"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moved: dict[date, Decimal] = {}
        for frame in rows:
            for day, debit, credit in zip(frame["day"], frame["debit"], frame["credit"], strict=True):
                moved[day] = moved.get(day, Decimal("0.00")) + credit - debit
        held = {k[0]: v[0] for k, v in self.days.iterator()}
        for day, amount in moved.items():
            if day not in held:
                self.handle.registerTimer(_millis(datetime.combine(day, time()) + timedelta(days=1)))
            held[day] = held.get(day, Decimal("0.00")) + amount
            self.days.updateValue((day,), (held[day],))
        if held:
            yield self._judge(key[0], held, max(held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, timezone.utc).date()
        held = {k[0]: v[0] for k, v in self.days.iterator()}
        yield self._judge(key[0], held, until)
        balance, below = self.before.get() if self.before.exists() else (Decimal("0.00"), False)
        for day in sorted(d for d in held if d < until):
            balance += held[day]
            below = balance < 0
            self.days.removeKey((day,))
            if self.sent.containsKey((day,)):
                self.sent.removeKey((day,))
        self.before.update((balance, below))


def cash_alert(movement: DataFrame, delay: str = "2 days") -> DataFrame:
    """account_id, day, balance, kind (alert, correction, withdrawn) from movements (account_id, day, debit, credit), in any order within the delay."""
    timed = movement.withColumn("ts", F.col("day").cast("timestamp")).withWatermark("ts", delay)
    return _with_state(timed, ["account_id"], CashAlert(), ALERT)


BREAK = "firm_id int, segment int, id long, ok boolean"


class ChainVerify(StatefulProcessor):
    """Each audit row against the one before it, per segment of a firm, whatever the order of arrival.

    State: the last hash that was judged and the rows that wait for theirs, by the hash they follow. A row is judged when its turn comes. Once the
    watermark has passed a waiting row's time, the missing one is given up: the first waiting row is reported as a break, and the chain
    goes on from it. A second row that follows a hash already waited for is a break at once, unless it is the same row again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "hash string")
        self.waiting = handle.getMapState("waiting", "prev string", "id long, own string, expected string, due long")

    def _drain(self, last: str, out: list[tuple]) -> str:
        while self.waiting.containsKey((last,)):
            own_id, own, expected, _ = self.waiting.getValue((last,))
            self.waiting.removeKey((last,))
            out.append((own_id, own == expected))
            last = own
        self.last.update((last,))
        return last

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"firm_id": key[0], "segment": key[1], "id": [x for x, _ in out], "ok": [x for _, x in out]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for frame in rows:
            for own_id, moment, prev, own, expected in zip(*(frame[c] for c in ("id", "ts", "prev_hash", "row_hash", "expected")), strict=True):
                if self.waiting.containsKey((prev,)):
                    held = self.waiting.getValue((prev,))
                    if (held[0], held[1]) != (own_id, own):
                        out.append((int(own_id), False))
                    continue
                due = _millis(moment.to_pydatetime())
                self.waiting.updateValue((prev,), (int(own_id), own, expected, due))
                self.handle.registerTimer(due)
        self._drain(self.last.get()[0] if self.last.exists() else GENESIS, out)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        while overdue := sorted((v[0], k[0], v[1]) for k, v in self.waiting.iterator() if v[3] <= now):
            own_id, prev, own = overdue[0]
            self.waiting.removeKey((prev,))
            out.append((own_id, False))
            self._drain(own, out)
        yield self._frame(key, out)


def chain_verify(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """firm_id, segment, id, ok of each row (firm_id, segment, id, ts, prev_hash, row_hash, expected); expected is the hash made again from the row."""
    return _with_state(rows.withWatermark("ts", delay), ["firm_id", "segment"], ChainVerify(), BREAK)


def settlements(collections: DataFrame, bank: DataFrame, delay: str = "1 day", band_days: int = 3) -> DataFrame:
    """Each day's collections of an account with the bank credit that settles them; without one, once the watermark rules it out, nulls.

    collections: collection_id (sent again at times), client_id, account_id, amount, collected_at; bank: client_id, account_id, line_id, credit, ts. A settlement has the day's exact
    total and comes from the day itself to band_days after its end.
    """
    once = collections.withWatermark("collected_at", delay).dropDuplicatesWithinWatermark(["collection_id"])
    day = once.groupBy(F.window("collected_at", "1 day"), "client_id", "account_id").agg(
        F.sum("amount").cast("decimal(18,2)").alias("batch_total"), F.count(F.lit(1)).alias("collections")).select(
        "client_id", "account_id", "batch_total", "collections", F.window_time("window").alias("day_end"), F.col("window.start").cast("date").alias("day"))
    credit = bank.withWatermark("ts", delay).select(F.col("client_id").alias("b_client"), F.col("account_id").alias("b_account"), "line_id", "credit", "ts")
    near = F.expr(f"ts >= day_end - interval 1 day AND ts <= day_end + interval {band_days} days")
    same = (F.col("client_id") == F.col("b_client")) & (F.col("account_id") == F.col("b_account")) & (F.col("batch_total") == F.col("credit"))
    return day.join(credit, same & near, "left_outer").select(
        "client_id", "account_id", "day", "batch_total", "collections", "line_id", F.col("line_id").isNotNull().alias("double_counted"))
