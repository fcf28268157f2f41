"""Projections, searches and row rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens import schemas
from provlens.functions.identifiers import HEX64

ISO_SECOND = "^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z$"
SAFE_ID = "^[A-Za-z0-9._\\-]+$"
SIGNATURE_HEX = "^[a-f0-9]{128}$"


def list_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.select("archive_id", "hash", "kind", "mime_type", "size_bytes",
                           "ingested_at", "ingested_by", "source_id")


def search_evidence(evidence: DataFrame, text: str = "", kind: str | None = None) -> DataFrame:
    """Case-insensitive substring over hash, kind, media type, actor and source."""
    out = evidence if kind is None else evidence.filter(F.col("kind") == kind)
    if not text:
        return out
    q = F.lit(text.lower())
    hits = [F.coalesce(F.contains(F.lower(c), q), F.lit(False))
            for c in ("kind", "mime_type", "ingested_by", "source_id")]
    return out.filter(reduce(Column.__or__, hits, F.contains(F.col("hash"), q)))


def filter_audit(log: DataFrame, action: str | None = None) -> DataFrame:
    return log if action is None else log.filter(F.col("action") == action)


def search_manifests(manifests: DataFrame, prefix: str) -> DataFrame:
    """Manifests with a hash starting with ``prefix`` (four characters or more)."""
    q = prefix.strip().lower()
    if len(q) < 4:
        return manifests.withColumn("matched_field", F.lit(None).cast("string")).filter(F.lit(False))
    columns = ("manifest_hash", "previous_manifest_hash", "audit_chain_head_hash",
               "public_key_fingerprint")
    matched = F.coalesce(*[F.when(F.col(c).startswith(q), F.lit(c)) for c in columns])
    return manifests.withColumn("matched_field", matched).filter("matched_field IS NOT NULL")


# --- rules ---------------------------------------------------------------------------------


def _filled(name: str) -> Column:
    return F.length(name) > 0


def _filled_or_null(name: str) -> Column:
    return F.col(name).isNull() | (F.length(name) > 0)


def _hex(name: str) -> Column:
    return F.col(name).rlike(HEX64)


def _whole_second(name: str) -> Column:
    return F.date_trunc("second", name) == F.col(name)


def _sorted(array: Column) -> Column:
    return F.array_sort(array) == array


def _unique(array: Column) -> Column:
    return F.size(F.array_distinct(array)) == F.size(array)


def _typed(name: str, suffix: str) -> Column:
    return F.col(name).rlike(f"^[A-Za-z][A-Za-z0-9]*\\.{suffix}$")


def _violations(df: DataFrame, row_id: Column, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; a rule that evaluates to null counts as broken."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return (df.select("archive_id", row_id.alias("row_id"), broken.alias("rule"))
            .withColumn("rule", F.explode("rule")))


def _row_rules(table: str) -> tuple[Column, dict[str, Column]]:
    if table == "evidence":
        return F.col("hash"), {
            "hash_format": _hex("hash"),
            "kind_known": F.col("kind").isin(schemas.EVIDENCE_KINDS),
            "content_uri_filled": _filled("content_uri"),
            "content_uri_posix": ~F.contains(F.col("content_uri"), F.lit("\\")),
            "size_not_negative": F.col("size_bytes") >= 0,
            "mime_type_filled": _filled("mime_type"),
            "source_id_filled": _filled("source_id"),
            "status_known": F.col("status").isin(schemas.EVIDENCE_STATUSES),
            "ingested_at_present": F.col("ingested_at").isNotNull(),
            "ingested_by_filled": _filled("ingested_by"),
            "schema_version_filled": _filled("schema_version"),
        }
    if table == "sources":
        return F.col("id"), {
            "id_format": F.col("id").rlike("^[A-Za-z0-9][A-Za-z0-9._\\-]*$"),
            "kind_known": F.col("kind").isin(schemas.SOURCE_KINDS),
            "name_filled": _filled("name"),
            "authority_known": F.col("authority").isin(schemas.AUTHORITY_LEVELS),
            "jurisdiction_format":
                F.col("jurisdiction").isNull() | F.col("jurisdiction").rlike("^[A-Z]{2}$"),
        }
    if table == "provenance":
        steps = F.transform("steps", lambda s: s["step_id"])
        return F.col("evidence_hash"), {
            "evidence_hash_format": _hex("evidence_hash"),
            "origin_source_id_filled": _filled("origin_source_id"),
            "step_id_positive": F.forall(steps, lambda n: n >= 1),
            "step_id_unique": _unique(steps),
            "step_kind_known": F.forall("steps", lambda s: s["kind"].isin(schemas.STEP_KINDS)),
            "step_links_format": F.forall(
                "steps", lambda s: F.forall(
                    F.concat(F.coalesce(s["inputs"], F.array().cast("array<string>")),
                             F.coalesce(s["outputs"], F.array().cast("array<string>"))),
                    lambda h: h.rlike(HEX64))),
            "gap_described": F.forall("gaps", lambda g: F.length(g["description"]) > 0),
            "complete_without_gaps": ~F.col("is_complete") | (F.size("gaps") == 0),
            "attestor_filled": _filled("attestor"),
            "attested_at_present": F.col("attested_at").isNotNull(),
        }
    if table == "authentication_assessments":
        ids = F.col("supporting_source_ids")
        return F.col("assessment_id"), {
            "assessment_id_format": F.col("assessment_id").rlike(SAFE_ID),
            "evidence_id_format": _hex("evidence_id"),
            "created_at_whole_second": _whole_second("created_at"),
            "method_known": F.col("method").isin(schemas.ASSESSMENT_METHODS),
            "status_known": F.col("status").isin(schemas.ASSESSMENT_STATUSES),
            "rationale_filled": _filled("rationale"),
            "source_ids_unique": _unique(ids),
            "source_ids_sorted": _sorted(ids),
            "schema_version_filled": _filled("schema_version"),
        }
    if table == "audit_log":
        return F.col("seq").cast("string"), {
            "seq_not_negative": F.col("seq") >= 0,
            "prev_hash_format": _hex("prev_hash"),
            "timestamp_whole_second": _whole_second("timestamp"),
            "actor_filled": _filled("actor"),
            "action_known": F.col("action").isin(schemas.ACTIONS),
            "target_filled": _filled("target"),
            "result_known": F.col("result").isin(schemas.RESULTS),
            "schema_version_filled": _filled("schema_version"),
            "entry_hash_format": _hex("entry_hash"),
        }
    raise ValueError(f"no rules for table {table!r}")


def validate_rows(df: DataFrame, table: str) -> DataFrame:
    """``(archive_id, row_id, rule)`` for every model rule a row breaks."""
    row_id, rules = _row_rules(table)
    return _violations(df, row_id, rules)


def _reference_rules(name: str) -> dict[str, Column]:
    pairs = F.transform(name, lambda r: F.struct(r["reference_type"], r["identifier"]))
    return {
        "reference_type_known": F.forall(
            name, lambda r: r["reference_type"].isin(schemas.REFERENCE_TYPES)),
        "reference_identifier_filled": F.forall(name, lambda r: F.length(r["identifier"]) > 0),
        "reference_hash_format": F.forall(name, lambda r: r["artifact_hash"].rlike(HEX64)),
        "references_unique": _unique(pairs),
        "references_sorted": _sorted(F.col(name)),
    }


def _artifact_rules(kind: str) -> tuple[Column, dict[str, Column]]:
    if kind == "workspace":
        return F.col("workspace_id"), {
            "id_format": F.col("workspace_id").rlike(SAFE_ID),
            "title_filled": _filled("title"),
            "source_manifest_hash_format": _hex("source_manifest_hash"),
            "self_hash_format": _hex("workspace_hash"),
            **_reference_rules("references"),
        }
    if kind == "snapshot":
        return F.col("snapshot_id"), {
            "id_format": F.col("snapshot_id").rlike(SAFE_ID),
            "workspace_hash_format": _hex("workspace_hash"),
            "timeline_hash_format": _hex("timeline_hash"),
            "self_hash_format": _hex("snapshot_hash"),
            **_reference_rules("referenced_artifacts"),
        }
    if kind == "timeline":
        events = F.col("ordered_events")
        order = F.transform(events, lambda e: F.struct(
            e["observed_at"], e["artifact_hash"], e["artifact_type"], e["artifact_identifier"],
            e["source_reference"]))
        return F.col("timeline_id"), {
            "id_format": F.col("timeline_id").rlike(SAFE_ID),
            "workspace_hash_format": _hex("workspace_hash"),
            "self_hash_format": _hex("timeline_hash"),
            "event_count_agrees": F.col("event_count") == F.size(events),
            "events_sorted": _sorted(order),
            "event_time_whole_second": F.forall(events, lambda e: e["observed_at"].rlike(ISO_SECOND)),
            "event_fields_filled": F.forall(events, lambda e: reduce(Column.__and__, [
                F.length(e[n]) > 0 for n in ("artifact_hash", "artifact_type",
                                             "artifact_identifier", "source_reference")])),
            "first_timestamp_agrees":
                F.col("first_timestamp").eqNullSafe(F.try_element_at(events, F.lit(1))["observed_at"]),
            "last_timestamp_agrees":
                F.col("last_timestamp").eqNullSafe(F.try_element_at(events, F.lit(-1))["observed_at"]),
        }
    if kind == "justification":
        categories = ("minimal_evidence", "supporting_assessments", "graph_nodes_used",
                      "intermediate_artifacts", "provenance_chain")
        order = {c: F.transform(c, lambda e: F.struct(e["entry_role"], e["entry_identifier"],
                                                      e["entry_hash"])) for c in categories}
        return F.col("justification_id"), {
            "id_format": F.col("justification_id").rlike(SAFE_ID),
            "anchor_type_known": F.col("conclusion_anchor_type") == "assessment",
            "anchor_id_filled": _filled("conclusion_anchor_id"),
            "anchor_hash_format": _hex("conclusion_anchor_hash"),
            "source_manifest_hash_format": _hex("source_manifest_hash"),
            "self_hash_format": _hex("justification_hash"),
            "workspace_hash_format": F.col("workspace_hash").isNull() | _hex("workspace_hash"),
            "entry_role_known": reduce(Column.__and__, [
                F.forall(c, lambda e: e["entry_role"].isin(schemas.ENTRY_ROLES))
                for c in categories]),
            "entries_sorted": reduce(Column.__and__, [_sorted(order[c]) for c in categories]),
            "entries_unique": reduce(Column.__and__, [_unique(order[c]) for c in categories]),
        }
    raise ValueError(f"no rules for artifact kind {kind!r}")


def validate_artifacts(df: DataFrame, kind: str) -> DataFrame:
    """As :func:`validate_rows`, for landed derived artifacts."""
    row_id, rules = _artifact_rules(kind)
    return _violations(df, row_id, rules)


def validate_transparency(manifests: DataFrame) -> DataFrame:
    counts = ("audit_entry_count", "evidence_count", "attestation_count", "workspace_count",
              "timeline_count", "snapshot_count", "justification_count")
    hashes = ("public_key_fingerprint", "archive_manifest_hash", "audit_chain_head_hash",
              "previous_manifest_hash", "manifest_hash")
    return _violations(manifests, F.col("sequence").cast("string"), {
        "sequence_not_negative": F.col("sequence") >= 0,
        "signed_at_format": F.col("signed_at").rlike(ISO_SECOND),
        "manifest_type_known": _typed("manifest_type", "transparency\\.manifest\\.v1"),
        "operator_id_filled": _filled("operator_id"),
        **{f"{h}_format": _hex(h) for h in hashes},
        **{f"{c}_not_negative": F.col(c) >= 0 for c in counts},
        "signature_format": F.col("signature").rlike(SIGNATURE_HEX),
        "signature_algorithm_known": F.col("signature_algorithm") == schemas.SIGNATURE_ALGORITHM,
        "bootstrap_previous_is_zero":
            (F.col("sequence") != 0) | (F.col("previous_manifest_hash") == schemas.ZERO_HASH),
    })


def validate_witnesses(witnesses: DataFrame) -> DataFrame:
    return _violations(witnesses, F.col("attestation_hash"), {
        "attestation_type_known": _typed("attestation_type", "transparency\\.witness\\.v1"),
        "witness_operator_id_filled": _filled("witness_operator_id"),
        "witness_public_key_fingerprint_format": _hex("witness_public_key_fingerprint"),
        "target_manifest_hash_format": _hex("target_manifest_hash"),
        "target_manifest_sequence_not_negative": F.col("target_manifest_sequence") >= 0,
        "target_operator_id_filled": _filled("target_operator_id"),
        "witnessed_at_format": F.col("witnessed_at").rlike(ISO_SECOND),
        "statement_filled_or_null": _filled_or_null("statement"),
        "signature_format": F.col("signature").rlike(SIGNATURE_HEX),
        "signature_algorithm_known": F.col("signature_algorithm") == schemas.SIGNATURE_ALGORITHM,
        "attestation_hash_format": _hex("attestation_hash"),
    })


def validate_certificates(certificates: DataFrame) -> DataFrame:
    return _violations(certificates, F.col("certificate_hash"), {
        "certificate_type_known": _typed("certificate_type", "capture\\.certificate\\.v1"),
        "evidence_sha256_format": _hex("evidence_sha256"),
        "operator_id_filled": _filled("operator_id"),
        "captured_at_format": F.col("captured_at").rlike(ISO_SECOND),
        **{f"{c}_filled_or_null": _filled_or_null(c) for c in ("device_id", "location", "notes")},
        "public_key_fingerprint_format": _hex("public_key_fingerprint"),
        "signature_format": F.col("signature").rlike(SIGNATURE_HEX),
        "signature_algorithm_known": F.col("signature_algorithm") == schemas.SIGNATURE_ALGORITHM,
        "certificate_hash_format": _hex("certificate_hash"),
    })


def source_conflicts(incoming: DataFrame, sources: DataFrame) -> DataFrame:
    """Fields in which an incoming source contradicts the stored one of the same id."""
    fields = ("name", "kind", "authority", "jurisdiction", "license")
    pairs = (incoming.select("archive_id", "id", F.struct(*fields).alias("new"))
             .join(sources.select("archive_id", "id", F.struct(*fields).alias("old")),
                   ["archive_id", "id"]))
    clash = F.array_compact(F.array(*[
        F.when(F.col(f"new.{f}").isNotNull() & ~F.col(f"new.{f}").eqNullSafe(F.col(f"old.{f}")),
               F.struct(F.lit(f).alias("field"), F.col(f"new.{f}").alias("provided"),
                        F.col(f"old.{f}").alias("stored")))
        for f in fields]))
    return (pairs.select("archive_id", "id", F.explode(clash).alias("c"))
            .select("archive_id", "id", "c.field", "c.provided", "c.stored"))


def list_artifacts(df: DataFrame, kind: str) -> DataFrame:
    """Short listings of landed artifacts, as shown in an overview."""
    if kind == "inference_proof":
        return df.select(
            "archive_id", "proof_id", "proof_hash", "target_justification_id",
            "target_justification_hash", "conclusion_claim_id",
            F.size("premises").cast("long").alias("premise_count"),
            F.size("inferences").cast("long").alias("inference_count"),
            F.size("derived_claims").cast("long").alias("derived_claim_count"))
    if kind == "attestation":
        return df.select("archive_id", F.col("artifact_name").alias("id"), "artifact_kind",
                         "signer_id", "signed_at", "attestation_hash")
    if kind == "transparency_manifest":
        return df.select(
            "archive_id", "sequence", "manifest_hash", "previous_manifest_hash",
            "audit_chain_head_hash", "audit_entry_count", "evidence_count", "attestation_count",
            "signed_at", "operator_id", "public_key_fingerprint")
    return df.select("archive_id", F.col(f"{kind}_id").alias("id"), f"{kind}_hash")
