"""Cutting lineage where several later steps read one derived table."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder that all executors share; see stage."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-rokad-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_shared(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder, as compressed columns, and read them from there.

    The folder is the one the session names in spark.checkpoint.dir. Where none is named, a session on one machine
    (tests, bench) makes a temporary one, and a cluster fails: its executors could not share such a folder. Later steps read only the columns they
    use; a checkpoint would hold whole uncompressed rows.
    """
    path = new_path(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
