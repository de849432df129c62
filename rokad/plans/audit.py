"""Audit chain: verification is parallel inside a firm; sealing works on bounded segments."""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.audit import GENESIS, audit_payload, audit_row_hash
from ..operators.prefix import carry_forward

ID_SPAN = 65536


def seal_segments(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Add prev_hash and row_hash: every scope starts at the genesis value and links row to row.

    A scope must be bounded (a firm and a fixed run of ids), as each hash needs the one before it.
    """
    df = rows.withColumn("_payload", audit_payload())
    schema = df.select("id", *scope).schema.add("prev_hash", "string").add("row_hash", "string")

    def link(pdf):
        pdf = pdf.sort_values("id")
        prev, before, after = GENESIS, [], []
        for payload in pdf["_payload"]:
            before.append(prev)
            prev = hashlib.sha256(f"{prev}|{payload}".encode()).hexdigest()
            after.append(prev)
        return pdf[["id", *scope]].assign(prev_hash=before, row_hash=after)

    sealed = df.select("id", *scope, "_payload").groupBy(*scope).applyInPandas(link, schema)
    return rows.join(sealed.select("id", "prev_hash", "row_hash"), "id")


def verify(sealed: DataFrame, scope: list[str]) -> DataFrame:
    """First broken row of each scope, if any.

    The previous row's hash is carried along in ordered chunks of ids, so one firm with most of
    the rows is still checked by many tasks.
    """
    df = sealed.withColumn("_chunk", F.floor(F.col("id") / ID_SPAN))
    df = carry_forward(df, scope, ["_chunk"], ["id"], {"_prior": F.col("row_hash")})
    good = (F.col("prev_hash") == F.coalesce("_prior", F.lit(GENESIS))) & (
        F.col("row_hash") == audit_row_hash(F.col("prev_hash")))
    return df.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("checked"), F.min(F.when(~good, F.col("id"))).alias("broken_at")).withColumn(
        "ok", F.col("broken_at").isNull())


def checkpoints(sealed: DataFrame, scope: list[str]) -> DataFrame:
    """Last hash of each scope and day."""
    return sealed.groupBy(*scope, F.col("occurred_at").cast("date").alias("day")).agg(
        F.max_by("row_hash", "id").alias("terminal_hash"), F.max("id").alias("last_id"))


def segment_facts(sealed: DataFrame, owner: list[str], segment: str) -> DataFrame:
    """Rows, last id and last hash of each sealed segment: what a change, a gap or a cut tail of a segment alters."""
    return sealed.groupBy(*owner, segment).agg(
        F.count(F.lit(1)).alias("rows"), F.max("id").alias("last_id"), F.max_by("row_hash", "id").alias("digest"))


def link_segments(facts: DataFrame, owner: list[str], segment: str) -> DataFrame:
    """A second, short chain over an owner's segments in order, so that none can be left out unseen.

    It is sequential per owner, over one row per segment.
    """
    schema = facts.select(*owner, segment, "rows", "last_id", "digest").schema
    schema = type(schema)([*schema.fields]).add("prev_link", "string").add("link", "string")

    def chain(pdf):
        pdf = pdf.sort_values(segment)
        prev, before, after = GENESIS, [], []
        for at, rows, last, digest in zip(pdf[segment], pdf["rows"], pdf["last_id"], pdf["digest"], strict=True):
            before.append(prev)
            prev = hashlib.sha256(f"{prev}|{at}|{rows}|{last}|{digest}".encode()).hexdigest()
            after.append(prev)
        return pdf.assign(prev_link=before, link=after)[schema.names]

    return facts.select(*owner, segment, "rows", "last_id", "digest").groupBy(*owner).applyInPandas(chain, schema)


def verify_segments(sealed: DataFrame, links: DataFrame, owner: list[str], segment: str) -> DataFrame:
    """Per owner, segments linked and the first that is missing, cut, changed or was never linked."""
    now = segment_facts(sealed, owner, segment).select(
        *owner, segment, F.col("rows").alias("_rows"), F.col("last_id").alias("_last"), F.col("digest").alias("_digest"))
    j = links.join(now, [*owner, segment], "full_outer")
    same = (F.col("rows") == F.col("_rows")) & (F.col("last_id") == F.col("_last")) & (F.col("digest") == F.col("_digest"))
    return j.groupBy(*owner).agg(
        F.count("link").alias("segments"), F.min(F.when(~F.coalesce(same, F.lit(False)), F.col(segment))).alias("broken_at")
    ).withColumn("ok", F.col("broken_at").isNull())
