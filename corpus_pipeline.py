"""The training-data pipeline: each stage calls one operator of rokad.llm on all that the one before kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rokad.llm.common import choose_by_id, stage, table
from rokad.llm.langid import identify, train
from rokad.llm.linededup import dedup_lines
from rokad.llm.mixing import mix, take
from rokad.llm.neardup import near_duplicates
from rokad.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language: texts without a letter, or without any n-gram of a learned language, go."""
    named = identify(docs, train(docs))
    return named.filter((F.col("lang_pred") != "und") & (F.col("score") > 0)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near duplicates (five-word shingles, similarity 0.8), and all others."""
    gone = stage(near_duplicates(docs).filter("not kept").select("doc_id").distinct())
    return choose_by_id(docs, gone, "doc_id", keep=False)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it: rows repeat, and rows without a copy go."""
    return take(docs, mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("packing", packing)]
#: Language, rounding and packing have no SQL form; the pipeline is tested against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
