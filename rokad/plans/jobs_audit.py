"""Audit, lineage and provenance jobs."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import masters as m
from ..functions.money import MONEY
from ..operators.effective import resolve_gst_rate
from ..operators.staging import stage
from . import audit as a
from ..operators.prefix import carry_forward, ordinal
from .registry import job

#: Ids in one run of an entity's rows.
VERSION_SPAN = 65_536

SCOPE = ["firm_id", "segment"]


@job("build_audit_chain")
def build_audit_chain(b):
    return a.seal_segments(b.audit_rows, SCOPE).select("id", *SCOPE, "prev_hash", "row_hash")


@job("verify_audit_chain")
def verify_audit_chain(b):
    """A sealed log in which the content of two rows was changed afterwards."""
    sealed = stage(a.seal_segments(b.audit_rows, SCOPE))
    tampered = sealed.withColumn("after", F.when(F.col("id").isin(77, 503), F.lit('{"k": 0, "edited": true}')).otherwise(F.col("after")))
    return a.verify(tampered, SCOPE)


@job("chain_checkpoints")
def chain_checkpoints(b):
    return a.checkpoints(a.seal_segments(b.audit_rows, SCOPE), SCOPE)


@job("audit_segment_chain")
def audit_segment_chain(b):
    """The chain over each firm's sealed segments."""
    return a.link_segments(a.segment_facts(a.seal_segments(b.audit_rows, SCOPE), ["firm_id"], "segment"), ["firm_id"], "segment")


@job("verify_audit_segments")
def verify_audit_segments(b):
    """A sealed log of which one firm lost a whole segment and another the last row."""
    sealed = stage(a.seal_segments(b.audit_rows, SCOPE))
    links = a.link_segments(a.segment_facts(sealed, ["firm_id"], "segment"), ["firm_id"], "segment")
    last = sealed.filter("firm_id = 3").agg(F.max("id").alias("_cut"))
    kept = sealed.filter("NOT (firm_id = 2 AND segment = 0)").join(F.broadcast(last), (F.col("firm_id") == 3) & (F.col("id") == F.col("_cut")), "left_anti")
    return a.verify_segments(kept, links, ["firm_id"], "segment")


@job("audit_by_entity")
def audit_by_entity(b):
    return b.audit_rows.groupBy("firm_id", "entity_type", "entity_id").agg(
        F.count(F.lit(1)).alias("changes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@job("audit_by_actor")
def audit_by_actor(b):
    return b.audit_rows.groupBy("firm_id", "client_id", "actor_user_id", "action").agg(F.count(F.lit(1)).alias("changes"))


@job("support_access")
def support_access(b):
    return b.audit_rows.filter("actor_type = 'support'").select("id", "firm_id", "client_id", "entity_type", "entity_id", "action")


@job("backdated_entries")
def backdated_entries(b):
    """Vouchers entered more than thirty days after their posting date."""
    gap = F.datediff("entered_on", "posting_date")
    return b.vouchers.filter(gap > 30).select("client_id", "voucher_id", "posting_date", "entered_on", gap.alias("days"))


@job("reversal_report")
def reversal_report(b):
    v = b.vouchers
    r = v.filter("reverses_id IS NOT NULL").select(
        F.col("voucher_id").alias("reversal_id"), F.col("reverses_id").alias("voucher_id"), "reason", F.col("created_by").alias("reversed_by"),
        F.col("posting_date").alias("reversed_on"))
    return v.select("client_id", "voucher_id", "posting_date").join(r, "voucher_id")


@job("origin_breakdown")
def origin_breakdown(b):
    ai = F.col("created_via") == "ai_proposal"
    return b.vouchers.groupBy("client_id", "voucher_type").agg(
        F.count(F.lit(1)).alias("vouchers"), F.count_if(ai).alias("machine"), F.count_if(ai & F.col("ai_edited")).alias("machine_edited"))


def periods(audit):
    """Latest close or reopen event per client and month decides."""
    e = audit.filter("action IN ('approve', 'reverse')")
    return e.groupBy("client_id", F.date_format("occurred_at", "yyyy-MM").alias("period")).agg(
        F.max_by(F.when(F.col("action") == "approve", "closed").otherwise("open"), "id").alias("status"), F.max("id").alias("event_id"))


@job("period_status")
def period_status(b):
    return periods(b.audit_rows)


@job("account_versions")
def account_versions(b):
    """Version rows where the stored snapshot of an entity changed; an entity's rows are compared across bounded runs of ids."""
    keys, levels = ["entity_type", "entity_id"], ["_chunk"]
    d = b.audit_rows.select(*keys, "id", "after", F.floor(F.col("id") / VERSION_SPAN).alias("_chunk"))
    d = carry_forward(d, keys, levels, ["id"], {"_before": F.struct("after")})
    d = ordinal(d.filter(~F.col("_before.after").eqNullSafe(F.col("after")) | F.col("_before").isNull()), keys, levels, ["id"], "version")
    return d.select(*keys, "id", F.col("version").cast("int").alias("version"), F.get_json_object("after", "$.k").alias("k"))


@job("applied_rules")
def applied_rules(b):
    """Rate row cited by each line of documents, with the row as it was."""
    j = resolve_gst_rate(b.sales_lines.select("voucher_id", "hsn", "posting_date").distinct(), m.gst_rates(b.spark), "hsn", "posting_date")
    return j.filter("master_rate_id IS NOT NULL").select("voucher_id", "hsn", F.lit("gst_rate").alias("rule_type"), F.col("master_rate_id").alias("rule_row_id"), F.to_json(
        F.struct(F.col("master_hsn_prefix").alias("prefix"), F.col("master_rate_id").alias("id"))).alias("rule_snapshot"), F.col("master_citation").alias("citation"))


@job("computation_traces")
def computation_traces(b):
    """Expression, inputs and result of each tax figure."""
    c = F.col
    rows = b.sales_lines.filter("treatment = 'taxable'").select("voucher_id", "pk", "line_number", F.explode(F.array(
        F.struct(F.lit("cgst_amount").alias("output_field"), F.lit("taxable_value × gst_rate ÷ 2").alias("expression"), c("cgst").alias("result")),
        F.struct(F.lit("igst_amount").alias("output_field"), F.lit("taxable_value × gst_rate").alias("expression"), c("igst").alias("result")))).alias("t"),
        "taxable", "gst_rate")
    return rows.filter("t.result > 0").select("voucher_id", "pk", "line_number", "t.output_field", "t.expression", "taxable", "gst_rate", "t.result")


@job("lineage_forward")
def lineage_forward(b):
    """Report figure to its legs, vouchers and documents: cost of sales of one year."""
    legs = b.document_legs.filter("account_code IN (5010, 5020) AND fy = 2025")
    docs = b.bills.select("voucher_id", "bill_number", F.col("party_id").alias("supplier_id"), "n_lines")
    return legs.join(docs, "voucher_id").select("client_id", "account_code", "voucher_id", "bill_number", "supplier_id", "n_lines", "debit", "credit")


@job("lineage_reverse")
def lineage_reverse(b):
    """From a document to every leg and report line it reaches: the report root each bill touches."""
    legs = b.document_legs.filter("voucher_type = 'purchase'").join(F.broadcast(b.chart.select("account_code", "root_type")), "account_code")
    return legs.groupBy("voucher_id", "root_type").agg(F.count(F.lit(1)).alias("legs"), (F.sum("signed_paise") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY).alias("net"))
