"""Table schemas and the closed vocabularies of the record formats."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, B, TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()
STRINGS = T.ArrayType(S)
STRING_MAP = T.MapType(S, S)

# Prefix of record URIs and type names (``<namespace>:evidence/sha256:<hash>``).
# Readers accept any prefix; writers use the one given, so pass the prefix the
# archives already use.
NAMESPACE = "prov"


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


# Vocabularies of the record formats.
EVIDENCE_KINDS = [
    "document_text", "document_scan", "still_image", "moving_image", "audio_recording",
    "sensor_log", "dataset_table", "spatial_data", "code_or_model", "correspondence",
    "interview_transcript", "physical_specimen_report", "composite",
]
EVIDENCE_STATUSES = ["active", "superseded", "disputed", "retracted", "quarantined"]
SOURCE_KINDS = [
    "government_archive", "military_report", "academic_publication", "civilian_organization",
    "news_outlet", "witness_testimony", "personal_archive", "physical_artifact",
    "instrument_reading", "audiovisual_recording", "online_aggregator", "social_media", "unknown",
]
AUTHORITY_LEVELS = ["primary", "secondary", "tertiary", "unattributable"]
STEP_KINDS = [
    "original_capture", "analog_to_digital", "format_conversion", "ocr", "transcription",
    "translation", "redaction", "crop_or_excerpt", "enhancement", "attribution_change",
    "republication", "unknown_step",
]
ASSESSMENT_METHODS = ["manual_research", "provenance_review", "chain_of_custody_review"]
ASSESSMENT_STATUSES = ["unknown", "unverified", "partially_supported", "supported", "contradicted"]
ACTIONS = [
    "archive_bootstrap", "ingest_evidence", "assess_authentication", "build_workspace",
    "build_timeline", "build_snapshot", "build_justification", "sign_attestation",
]
DERIVED_ACTIONS = {
    "build_workspace": "workspace",
    "build_timeline": "timeline",
    "build_snapshot": "snapshot",
    "build_justification": "justification",
    "sign_attestation": "attestation",
    "assess_authentication": "assessment",
}
RESULTS = ["success", "failure"]
REFERENCE_TYPES = ["evidence", "assessment", "impact_analysis", "context_bundle"]
ENTRY_ROLES = ["evidence", "source", "assessment", "provenance_step", "graph_node"]
PREMISE_KINDS = ["observation", "documentary", "expert_assertion", "domain_axiom"]
CONCLUSIONS = ["explained", "unexplained", "indeterminate", "contaminated"]
FOOTPRINT_KINDS = ["github_user_keys", "https_pem"]
TABLES = ["evidence", "sources", "provenance", "provenance_steps", "authentication_assessments"]
ZERO_HASH = "0" * 64
SCHEMA_VERSION = "0.1.0"
ENGINE_VERSION = "1.0.0"
ARTIFACT_SCHEMA_VERSION = "1"
JUSTIFICATION_METHOD = "deductive_chain_v1"
ASSEMBLY_METHOD = "evidence_centric_v1"
SIGNATURE_ALGORITHM = "ed25519"
# End of fixed values.

STEP = struct(
    step_id=L, kind=S, actor=S, timestamp=S, inputs=STRINGS, outputs=STRINGS,
    parameters=STRING_MAP, notes=S,
)
GAP = struct(description=S)
REFERENCE = struct(reference_type=S, identifier=S, artifact_hash=S)
ENTRY = struct(entry_role=S, entry_identifier=S, entry_hash=S)
EVENT = struct(
    artifact_type=S, artifact_identifier=S, artifact_hash=S, observed_at=S, source_reference=S,
)
NODE_AT = struct(distance_from_anchor=L, node_type=S, node_id=S)

# Row payloads as stored (timestamps as text, so that canonical text round-trips).
PAYLOADS = {
    "evidence": struct(
        hash=S, kind=S, content_uri=S, size_bytes=L, mime_type=S, source_id=S, status=S,
        authentication=struct(status=S, assessor=S, assessed_at=S, method=S, notes=S),
        ingested_at=S, ingested_by=S, schema_version=S, notes=S, intrinsic_metadata=STRING_MAP,
    ),
    "sources": struct(
        id=S, kind=S, name=S, authority=S, jurisdiction=S, license=S, first_seen=S, notes=S,
    ),
    "provenance": struct(
        evidence_hash=S, origin_source_id=S, steps=T.ArrayType(STEP), is_complete=B,
        gaps=T.ArrayType(GAP), attestor=S, attested_at=S,
    ),
    "provenance_steps": STEP,
    "authentication_assessments": struct(
        assessment_id=S, evidence_id=S, created_at=S, method=S, status=S, rationale=S,
        supporting_source_ids=STRINGS, schema_version=S,
    ),
}

AUDIT_ENTRY = struct(
    seq=L, prev_hash=S, timestamp=S, actor=S, action=S, target=S, parameters=STRING_MAP,
    result=S, schema_version=S, entry_hash=S,
)

TRANSPARENCY = struct(
    sequence=L, signed_at=S, manifest_type=S, operator_id=S, public_key_fingerprint=S,
    archive_manifest_hash=S, audit_chain_head_hash=S, audit_entry_count=L, evidence_count=L,
    attestation_count=L, workspace_count=L, timeline_count=L, snapshot_count=L,
    justification_count=L, previous_manifest_hash=S, signature=S, signature_algorithm=S,
    manifest_hash=S, schema_version=S,
)
WITNESS = struct(
    attestation_type=S, schema_version=S, witness_operator_id=S,
    witness_public_key_fingerprint=S, target_manifest_hash=S, target_manifest_sequence=L,
    target_operator_id=S, witnessed_at=S, statement=S, signature=S, signature_algorithm=S,
    attestation_hash=S,
)
CERTIFICATE = struct(
    certificate_type=S, schema_version=S, evidence_sha256=S, operator_id=S, captured_at=S,
    device_id=S, location=S, notes=S, public_key_fingerprint=S, signature=S,
    signature_algorithm=S, certificate_hash=S,
)
PREMISE = struct(id=S, text=S, evidence_refs=STRINGS, kind=S)
INFERENCE = struct(id=S, rule=S, input_claim_ids=STRINGS, output_claim_id=S, text=S)
CLAIM = struct(id=S, text=S, inferred_by=S)

# Artifact kind -> (schema, self-hash column).
ARTIFACTS = {
    "workspace": (
        struct(workspace_id=S, title=S, references=T.ArrayType(REFERENCE),
               source_manifest_hash=S, workspace_hash=S, schema_version=S),
        "workspace_hash",
    ),
    "timeline": (
        struct(timeline_id=S, workspace_hash=S, ordered_events=T.ArrayType(EVENT),
               first_timestamp=S, last_timestamp=S, event_count=L, timeline_hash=S,
               schema_version=S),
        "timeline_hash",
    ),
    "snapshot": (
        struct(snapshot_id=S, workspace_hash=S, timeline_hash=S,
               referenced_artifacts=T.ArrayType(REFERENCE), snapshot_hash=S, schema_version=S),
        "snapshot_hash",
    ),
    "snapshot_diff": (
        struct(snapshot_a_hash=S, snapshot_b_hash=S, added_artifacts=T.ArrayType(REFERENCE),
               removed_artifacts=T.ArrayType(REFERENCE),
               unchanged_artifacts=T.ArrayType(REFERENCE), diff_hash=S, schema_version=S),
        "diff_hash",
    ),
    "justification": (
        struct(justification_id=S, conclusion_anchor_type=S, conclusion_anchor_id=S,
               conclusion_anchor_hash=S, minimal_evidence=T.ArrayType(ENTRY),
               supporting_assessments=T.ArrayType(ENTRY), graph_nodes_used=T.ArrayType(ENTRY),
               intermediate_artifacts=T.ArrayType(ENTRY), provenance_chain=T.ArrayType(ENTRY),
               workspace_hash=S, source_manifest_hash=S, justification_engine_version=S,
               justification_method_name=S, justification_hash=S, schema_version=S),
        "justification_hash",
    ),
    "justification_diff": (
        struct(justification_a_hash=S, justification_b_hash=S, added_entries=T.ArrayType(ENTRY),
               removed_entries=T.ArrayType(ENTRY), unchanged_entries=T.ArrayType(ENTRY),
               diff_hash=S, schema_version=S),
        "diff_hash",
    ),
    "context_bundle": (
        struct(anchor_node_kind=S, anchor_node_id=S, evidence=PAYLOADS["evidence"],
               source=PAYLOADS["sources"], provenance=PAYLOADS["provenance"],
               derived_assessments=T.ArrayType(PAYLOADS["authentication_assessments"]),
               graph_neighborhood=struct(upstream=T.ArrayType(NODE_AT),
                                         downstream=T.ArrayType(NODE_AT)),
               impact_report=struct(root_node_id=S, affected_assessments=STRINGS,
                                    affected_evidence=STRINGS, dependency_depth_max=L,
                                    total_affected_nodes=L, analysis_engine_version=S,
                                    schema_version=S),
               assembly_engine_version=S, assembly_method_name=S, schema_version=S,
               source_manifest_hash=S, context_bundle_hash=S),
        "context_bundle_hash",
    ),
    "archive_snapshot": (
        struct(manifest_hash=S, audit_log_head_hash=S, audit_log_total_entries=L,
               generated_at=S, snapshot_hash=S, schema_version=S),
        "snapshot_hash",
    ),
    "attestation": (
        struct(artifact_kind=S, artifact_hash=S, signer_id=S, public_key_fingerprint=S,
               signature=S, signature_algorithm=S, signed_at=S, attestation_hash=S,
               schema_version=S),
        "attestation_hash",
    ),
    "certificate": (CERTIFICATE, "certificate_hash"),
    "witness": (WITNESS, "attestation_hash"),
    "transparency_manifest": (TRANSPARENCY, "manifest_hash"),
    "inference_proof": (
        struct(proof_type=S, schema_version=S, proof_id=S, target_justification_id=S,
               target_justification_hash=S, premises=T.ArrayType(PREMISE),
               inferences=T.ArrayType(INFERENCE), derived_claims=T.ArrayType(CLAIM),
               conclusion_claim_id=S, proof_hash=S),
        "proof_hash",
    ),
}

# Self-hashed kinds told apart by their keys, in order: the first whose keys are
# all present wins. Fixed values.
KIND_KEYS = [
    ("workspace", ["workspace_id", "workspace_hash", "references"]),
    ("timeline", ["timeline_id", "timeline_hash", "ordered_events"]),
    ("snapshot", ["snapshot_id", "snapshot_hash", "referenced_artifacts"]),
    ("justification", ["justification_id", "justification_hash", "conclusion_anchor_type"]),
    ("context_bundle", ["context_bundle_hash", "assembly_method_name", "graph_neighborhood"]),
    ("attestation",
     ["signature", "signature_algorithm", "attestation_hash", "public_key_fingerprint"]),
    ("archive_snapshot",
     ["manifest_hash", "audit_log_head_hash", "audit_log_total_entries", "snapshot_hash"]),
]
