"""Headline jobs on one data directory; prints one JSON line."""
from __future__ import annotations

import json
import os
import time

from rokad.plans.registry import load
from rokad.session import local_session

QUERIES = [
    "trial_balance", "profit_and_loss", "balance_sheet", "invoice_totals", "bill_itc_header", "gstr1_hsn", "gstr3b",
    "itc_set_off", "recon_2b", "parse_narration", "statement_arithmetic", "cash_register", "open_invoices", "validate_invoices",
    "validate_ledger", "match_proposals", "allocate_receipts", "ingest_rows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    jobs, seconds = load(), {}
    for name in QUERIES:
        start = time.time()
        jobs[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
