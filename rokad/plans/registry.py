"""Every registered job: name -> callable(spark, data directory)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.returns import Tables

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def job(name: str):
    """Register a function of the domain tables under a job name."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            # staged columns are small for the work on their rows: files are not packed into few tasks
            spark.conf.set("spark.sql.files.openCostInBytes", "65536")
            # a generated method above this size is never compiled by the JVM; its operators then run one by one, in methods that are
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            return fn(Tables(spark, sf_dir))
        JOBS[name] = run
        return fn
    return wrap


def load() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import jobs_audit, jobs_bank, jobs_books, jobs_imports, jobs_ingest, jobs_tax  # noqa: F401
    return JOBS
