"""The collection feed: payments into accounts that were issued for one invoice, as JSON files that keep arriving."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "collection_id string, client_id int, account_id long, reference string, amount decimal(18,2), collected_at timestamp"


def stream_collections(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of the feed's rows, each collection_id once within the watermark that the reader of the stream sets; broken rows have null fields."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the feed so far, each collection once."""
    return spark.read.schema(SCHEMA).json(path).dropDuplicates(["collection_id"])
