"""Joins between records, logs, manifests, proofs and keys.

Join strategy is left to Catalyst and AQE: a side is broadcast only when its
measured size is below the threshold, and skewed keys are split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens import schemas
from provlens.functions import canonical as canon
from provlens.functions import identifiers as ids
from provlens.functions.ordered import running

_ASSESSMENT_FIELDS = ("assessment_id", "created_at", "method", "status", "rationale",
                      "supporting_source_ids")


def assessments_by_evidence(assessments: DataFrame) -> DataFrame:
    """At most one assessment per method, so the array per evidence stays short."""
    return (assessments.groupBy("archive_id", F.col("evidence_id").alias("hash"))
            .agg(F.array_sort(F.collect_list(F.struct(*_ASSESSMENT_FIELDS))).alias("assessments")))


def evidence_view(evidence: DataFrame, sources: DataFrame, provenance: DataFrame,
                  assessments: DataFrame) -> DataFrame:
    """Evidence with its source, custody record and assessments in id order."""
    src = sources.select("archive_id", F.col("id").alias("source_id"),
                         F.struct("name", "kind", "authority", "jurisdiction", "license").alias("source"))
    prov = provenance.select("archive_id", F.col("evidence_hash").alias("hash"),
                             F.struct("origin_source_id", "steps", "is_complete", "gaps", "attestor",
                                      "attested_at").alias("provenance"))
    return (evidence.join(src, ["archive_id", "source_id"])
            .join(prov, ["archive_id", "hash"], "left")
            .join(assessments_by_evidence(assessments), ["archive_id", "hash"], "left"))


def broken_source_refs(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    return (evidence.select("archive_id", "hash", "source_id")
            .join(sources.select("archive_id", F.col("id").alias("source_id")),
                  ["archive_id", "source_id"], "left_anti"))


def missing_blobs(evidence: DataFrame, blobs: DataFrame) -> DataFrame:
    return (evidence.select("archive_id", "hash")
            .join(blobs.select("archive_id", "hash"), ["archive_id", "hash"], "left_anti"))


def assess(evidence: DataFrame, sources: DataFrame, provenance: DataFrame, created_at: Column,
           method: str = "provenance_review") -> DataFrame:
    """One assessment per evidence from what the archive documents.

    A custody record whose origin is unknown contradicts; then an unknown source
    leaves it unverified; then custody without steps is partial support.
    """
    known = sources.select("archive_id", F.col("id").alias("source_id"), F.lit(True).alias("source_known"))
    origins = sources.select("archive_id", F.col("id").alias("origin_source_id"),
                             F.lit(True).alias("origin_known"))
    prov = provenance.select("archive_id", F.col("evidence_hash").alias("hash"), "origin_source_id",
                             (F.size("steps") > 0).alias("has_steps"), F.lit(True).alias("has_provenance"))
    joined = (evidence.select("archive_id", "hash", "source_id", created_at.alias("created_at"))
              .join(prov, ["archive_id", "hash"], "left")
              .join(known, ["archive_id", "source_id"], "left")
              .join(origins, ["archive_id", "origin_source_id"], "left"))
    status = (F.when(F.col("has_provenance") & F.col("origin_known").isNull(), F.lit("contradicted"))
              .when(F.col("source_known").isNull(), F.lit("unverified"))
              .when(~F.coalesce("has_steps", F.lit(False)), F.lit("partially_supported"))
              .otherwise(F.lit("supported")))
    support = F.when(F.col("source_known").isNotNull(), F.array("source_id")).otherwise(
        F.array().cast("array<string>"))
    return (joined.withColumn("status", status)
            .select("archive_id",
                    ids.assessment_id(F.col("hash"), F.lit(method)).alias("assessment_id"),
                    F.col("hash").alias("evidence_id"), "created_at", F.lit(method).alias("method"),
                    "status", ids.rationale(F.col("status")).alias("rationale"),
                    support.alias("supporting_source_ids"),
                    F.lit(schemas.SCHEMA_VERSION).alias("schema_version")))


def audit_entry_of(evidence: DataFrame, log: DataFrame) -> DataFrame:
    """First ingest entry of each evidence, null columns when the log has none."""
    first = (log.filter(F.col("action") == "ingest_evidence")
             .select("archive_id", ids.uri_hash(F.col("target")).alias("hash"), "pos",
                     F.struct("seq", "timestamp", "actor", "entry_hash", "parameters").alias("entry"))
             .filter("hash IS NOT NULL")
             .groupBy("archive_id", "hash").agg(F.min_by("entry", "pos").alias("entry")))
    return (evidence.select("archive_id", "hash").join(first, ["archive_id", "hash"], "left")
            .select("archive_id", "hash", "entry.*"))


def coverage(entries: DataFrame, manifests: DataFrame, witnesses: DataFrame | None = None) -> DataFrame:
    """Log manifests that cover an entry: those with ``audit_entry_count > seq``.

    ``entries`` has ``archive_id, hash, seq``. Instead of pairing every entry with
    every covering manifest, both are laid on one line by descending count and the
    manifests already passed are counted: the answer is the number of covering
    manifests, the earliest of them by sequence, and the smallest
    ``audit_entry_count`` among them (``least_count``), which names the whole set: it
    is the manifests with at least that count. ``witnesses`` (``archive_id,
    sequence, witness_count``) adds the witnesses of the covering manifests.
    """
    if witnesses is None:
        manifests = manifests.withColumn("witness_count", F.lit(0).cast("long"))
    else:
        manifests = (manifests.join(witnesses, ["archive_id", "sequence"], "left")
                     .withColumn("witness_count", F.coalesce("witness_count", F.lit(0))))
    kept = F.struct("sequence", "manifest_hash", "signed_at", "operator_id", "audit_entry_count",
                    "audit_chain_head_hash")
    marks = manifests.select("archive_id", (-F.col("audit_entry_count")).alias("line"),
                             F.lit(1).alias("side"), F.lit("").alias("hash"),
                             F.lit(None).cast("long").alias("seq"), F.lit(1).alias("one"),
                             "witness_count", kept.alias("first"), F.col("audit_entry_count").cast("long").alias("audit_entry_count"))
    points = entries.select("archive_id", (-F.col("seq")).alias("line"), F.lit(0).alias("side"),
                            "hash", F.col("seq").cast("long").alias("seq"), F.lit(0).alias("one"),
                            F.lit(0).cast("long").alias("witness_count"))
    both = marks.unionByName(points, allowMissingColumns=True)
    out = (running(both, ["archive_id"], ["line", "side", "hash", "first"],
                   {"covering": ("sum", "one"), "seen_by": ("sum", "witness_count"),
                    "earliest": ("min", "first"), "least_count": ("min", "audit_entry_count")})
           .filter(F.col("side") == 0)
           .select("archive_id", "hash", "seq", F.col("covering").alias("covering_manifests"),
                   F.col("seen_by").alias("covering_witnesses"),
                   F.col("earliest.sequence").alias("first_sequence"),
                   F.col("earliest.manifest_hash").alias("first_manifest_hash"),
                   F.col("earliest.signed_at").alias("first_signed_at"), "least_count"))
    return out.drop("covering_witnesses") if witnesses is None else out


def covering_manifests(entries: DataFrame, manifests: DataFrame, records: list[tuple[str, str]]) -> DataFrame:
    """Every covering manifest of the given records (archive id and hash), to look up a few."""
    kept = manifests.select("archive_id", "sequence", "manifest_hash", "signed_at", "operator_id",
                            "public_key_fingerprint", "audit_entry_count", "audit_chain_head_hash")
    wanted = F.struct("archive_id", "hash").isin([F.struct(F.lit(a), F.lit(h)) for a, h in records])
    return (entries.select("archive_id", "hash", "seq").filter(wanted).join(kept, "archive_id")
            .filter(F.col("audit_entry_count") > F.col("seq")))


def certificate_hash_of(provenance: DataFrame) -> DataFrame:
    """The certificate named by the first custody step that names one."""
    key = "capture_certificate_hash"
    named = F.filter(F.transform("steps", lambda s: F.element_at(s["parameters"], key)),
                     lambda h: h.isNotNull())
    return provenance.select("archive_id", F.col("evidence_hash").alias("hash"),
                             F.try_element_at(named, F.lit(1)).alias("certificate_hash"))


def certificate_of(provenance: DataFrame, certificates: DataFrame) -> DataFrame:
    named = certificate_hash_of(provenance).filter("certificate_hash IS NOT NULL")
    found = certificates.select("archive_id", "certificate_hash", "operator_id", "captured_at",
                                "device_id", "location", "notes", "public_key_fingerprint",
                                F.lit(True).alias("certificate_found"))
    return (named.join(found, ["archive_id", "certificate_hash"], "left")
            .withColumn("certificate_found", F.coalesce("certificate_found", F.lit(False))))


def certificate_binding(submitted: DataFrame, certificates: DataFrame) -> DataFrame:
    """``submitted`` pairs a blob with the certificate handed in for it.

    The certificate must hash to its own hash and must name that very blob.
    """
    checked = certificates.select(
        "archive_id", "certificate_hash", "evidence_sha256",
        (canon.self_hash(certificates, "certificate") == F.col("certificate_hash")).alias("intact"))
    status = (F.when(F.col("intact").isNull(), F.lit("missing"))
              .when(~F.col("intact"), F.lit("tampered"))
              .when(F.col("evidence_sha256") != F.col("hash"), F.lit("other_blob"))
              .otherwise(F.lit("bound")))
    return (submitted.select("archive_id", "hash", "certificate_hash")
            .join(checked, ["archive_id", "certificate_hash"], "left")
            .select("archive_id", "hash", "certificate_hash", status.alias("binding")))


def witness_target(witnesses: DataFrame, manifests: DataFrame) -> DataFrame:
    """Whether hash, sequence and operator of a witness agree with a log manifest."""
    target = manifests.select("archive_id", F.col("sequence").alias("target_manifest_sequence"),
                              "manifest_hash", "operator_id")
    return (witnesses.select("archive_id", "attestation_hash", "witness_operator_id",
                             "target_manifest_sequence", "target_manifest_hash", "target_operator_id")
            .join(target, ["archive_id", "target_manifest_sequence"], "left")
            .select("archive_id", "attestation_hash", "witness_operator_id", "target_manifest_sequence",
                    F.col("manifest_hash").isNotNull().alias("target_found"),
                    (F.col("target_manifest_hash").eqNullSafe(F.col("manifest_hash"))
                     & F.col("target_operator_id").eqNullSafe(F.col("operator_id"))).alias("target_ok")))


def case_view(workspaces: DataFrame, justifications: DataFrame, timelines: DataFrame) -> DataFrame:
    """Workspace with its last justification and number of timelines.

    ``workspaces`` brings ``reference_count`` or the ``references`` array.
    """
    count = (F.col("reference_count") if "reference_count" in workspaces.columns
             else F.size("references"))
    just = (justifications.filter("workspace_hash IS NOT NULL")
            .groupBy("archive_id", "workspace_hash")
            .agg(F.max("justification_id").alias("justification_id")))
    lines = timelines.groupBy("archive_id", "workspace_hash").agg(F.count("*").alias("timeline_count"))
    return (workspaces.select("archive_id", "workspace_id", "title", "workspace_hash",
                              count.cast("long").alias("evidence_count"))
            .join(just, ["archive_id", "workspace_hash"], "left")
            .join(lines, ["archive_id", "workspace_hash"], "left")
            .withColumn("timeline_count", F.coalesce("timeline_count", F.lit(0)))
            .withColumn("has_timeline", F.col("timeline_count") > 0))


def key_consistency(declared: DataFrame, present: DataFrame) -> DataFrame:
    """Declared against present key fingerprints.

    Both have ``archive_id, role`` (``operator`` or ``witness``) and
    ``public_key_fingerprint``; ``declared`` also names the ``owner_id``.
    """
    return (declared.filter("public_key_fingerprint <> ''").withColumn("declared", F.lit(True))
            .join(present.select("archive_id", "role", "public_key_fingerprint",
                                 F.lit(True).alias("present")).distinct(),
                  ["archive_id", "role", "public_key_fingerprint"], "full_outer")
            .select("archive_id", "role", "public_key_fingerprint", "owner_id",
                    F.when(F.col("declared").isNull(), F.lit("extra"))
                    .when(F.col("present").isNull(), F.lit("missing"))
                    .otherwise(F.lit("matched")).alias("state")))


def key_summary(states: DataFrame) -> DataFrame:
    """The per-archive report over :func:`key_consistency`."""
    operator, witness = F.col("role") == "operator", F.col("role") == "witness"
    return states.groupBy("archive_id").agg(
        F.max(F.coalesce(operator & (F.col("state") == "matched"), F.lit(False))).alias("operator_matches"),
        F.count_if(witness & (F.col("state") != "extra")).alias("witnesses_declared"),
        F.count_if(witness & (F.col("state") == "missing")).alias("witnesses_without_key"),
        F.count_if(witness & (F.col("state") == "extra")).alias("keys_not_declared"))


def anchor_match(claims: DataFrame, headers: DataFrame) -> DataFrame:
    """Merkle root claimed at a height against bytes 36 to 67 of the block header.

    A height may have several equal headers; where they name different roots, none is sure and
    nothing is anchored there.
    """
    root = F.lower(F.substring("header_hex", 73, 64))
    sure = headers.groupBy("height").agg(F.min(root).alias("low"), F.max(root).alias("header_root")).filter(
        F.col("low") == F.col("header_root")).drop("low")
    return (claims.join(sure, "height", "left")
            .withColumn("anchored", F.coalesce(
                F.lower("merkle_root") == F.col("header_root"), F.lit(False))))


def footprint_status(references: DataFrame, fetched: DataFrame) -> DataFrame:
    """Status of each published key reference.

    ``references``: ``archive_id, kind, uri, declared_fingerprint``; ``fetched``:
    ``kind, uri, fingerprints`` for every reference that could be read. A reference that was read
    several times has the fingerprints of all its rows.
    """
    once = fetched.groupBy("kind", "uri").agg(F.when(F.count("fingerprints") > 0, F.array_distinct(
        F.flatten(F.array_sort(F.collect_set("fingerprints"))))).alias("fingerprints"))
    got = F.col("fingerprints")
    status = (F.when(~F.col("kind").isin(schemas.FOOTPRINT_KINDS), F.lit("unsupported"))
              .when(got.isNull(), F.lit("unreachable"))
              .when(F.array_contains(got, F.col("declared_fingerprint")), F.lit("verified"))
              .otherwise(F.lit("mismatch")))
    shown = (F.when(F.col("status") == "verified", F.col("declared_fingerprint"))
             .when(F.col("status") == "mismatch", F.try_element_at(got, F.lit(1))))
    return (references.join(once, ["kind", "uri"], "left")
            .withColumn("status", status).withColumn("fetched_fingerprint", shown)
            .drop("fingerprints"))


def footprint_counts(statuses: DataFrame) -> DataFrame:
    s = F.col("status")
    return statuses.groupBy("archive_id").agg(
        F.count_if(s == "verified").alias("verified_count"),
        F.count_if(s == "mismatch").alias("mismatch_count"),
        F.count_if(s.isin("verified", "mismatch")).alias("reachable_count"),
        F.count_if(s != "unsupported").alias("supported_count"))


def signer_known(signed: DataFrame, keys: DataFrame, fingerprint: str = "public_key_fingerprint") -> DataFrame:
    """Flag signed records whose declared fingerprint belongs to a landed key."""
    landed = keys.select(F.col("public_key_fingerprint").alias(fingerprint),
                         F.lit(True).alias("signer_known")).distinct()
    return (signed.join(landed, fingerprint, "left")
            .withColumn("signer_known", F.coalesce("signer_known", F.lit(False))))
