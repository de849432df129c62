"""Audit-row payload and hash."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "0" * 64
PAYLOAD_FIELDS = [
    "firm_id", "client_id", "entity_type", "entity_id", "action", "before", "after",
    "actor_user_id", "actor_type", "ai_model", "approved_by",
]


def instant_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00'")


def audit_payload() -> Column:
    """Pipe-joined attested fields without the previous hash; stored JSON text is used as it is."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PAYLOAD_FIELDS]
    return F.concat_ws("|", *parts, instant_text(F.col("occurred_at")))


def audit_row_hash(prev: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, audit_payload()), 256)
