"""Everything known about an evidence, as one row or as a list of dated events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens.operators import aggregates, joins
from provlens.operators.proofs import Proofs, proofs_citing

KEY = ["archive_id", "hash"]


def report_data(evidence: DataFrame, sources: DataFrame, provenance: DataFrame, assessments: DataFrame,
                log: DataFrame, manifests: DataFrame, witnesses: DataFrame, proofs: Proofs,
                certificates: DataFrame) -> DataFrame:
    """One row per evidence: record, source, custody, certificate, log entry, cover, proofs.

    Covering manifests enter as their number, their witnesses and the earliest of
    them; :func:`provlens.operators.joins.covering_manifests` lists them for the
    few records one looks up.
    """
    view = joins.evidence_view(evidence, sources, provenance, assessments).select(
        *KEY, "kind", "mime_type", "size_bytes", "content_uri", "ingested_at", "ingested_by", "status",
        "source_id", F.col("source.name").alias("source_name"),
        F.col("source.authority").alias("source_authority"),
        F.size(F.coalesce("provenance.steps", F.array())).alias("step_count"), "assessments")
    entry = joins.audit_entry_of(evidence, log).select(
        *KEY, "seq", F.col("timestamp").alias("logged_at"), F.col("actor").alias("logged_by"), "entry_hash")
    cover = joins.coverage(entry.filter("seq IS NOT NULL"), manifests,
                           aggregates.witness_totals(witnesses)).drop("seq")
    cited = proofs_citing(evidence, proofs).groupBy(*KEY).agg(
        F.count("*").alias("proof_count"),
        F.sum("weak_inference_count").alias("weak_inference_count"))
    capture = joins.certificate_of(provenance, certificates).select(
        *KEY, "certificate_hash", F.col("operator_id").alias("captured_by"), "captured_at")
    out = reduce(lambda a, b: a.join(b, KEY, "left"), [view, entry, cover, cited, capture])
    return out.fillna(0, ["covering_manifests", "covering_witnesses", "proof_count", "weak_inference_count"])


def trust_timeline(evidence: DataFrame, provenance: DataFrame, log: DataFrame, manifests: DataFrame,
                   proofs: Proofs, certificates: DataFrame) -> DataFrame:
    """Capture, ingest, cover and citing proofs as ordered events; undated ones last.

    Cover is one event at the earliest covering manifest, with their number in
    ``count``: the later ones follow from the log and would repeat it per record.
    """
    def event(df: DataFrame, kind: str, at: Column, what: Column, count: Column) -> DataFrame:
        return df.select(*KEY, F.lit(kind).alias("kind"), at.alias("timestamp"),
                         what.alias("event_hash"), count.cast("long").alias("count"))

    one = F.lit(1)
    entry = joins.audit_entry_of(evidence, log).filter("seq IS NOT NULL")
    capture = joins.certificate_of(provenance, certificates).filter("certificate_found")
    cover = joins.coverage(entry, manifests).filter("covering_manifests > 0")
    events = reduce(DataFrame.unionByName, [
        event(capture, "capture", F.col("captured_at"), F.col("certificate_hash"), one),
        event(entry, "ingest", F.col("timestamp"), F.col("entry_hash"), one),
        event(cover, "manifest", F.col("first_signed_at"), F.col("first_manifest_hash"),
              F.col("covering_manifests")),
        event(proofs_citing(evidence, proofs), "proof", F.lit(None).cast("string"),
              F.col("proof_hash"), one)])
    return events.orderBy(*KEY, F.asc_nulls_last("timestamp"), "kind", "event_hash")
