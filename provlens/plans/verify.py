"""Whole-archive verification, derived-artifact integrity and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlens import schemas
from provlens.functions import canonical as canon
from provlens.functions import identifiers as ids
from provlens.operators import aggregates, chains, joins, sets

ISSUE = ["archive_id", "artifact_kind", "artifact_id", "issue_kind", "detail"]


def row_integrity(rows: DataFrame) -> DataFrame:
    """Stored hash against the payload, and whether the payload text is canonical.

    ``rows``: ``archive_id, table, row_hash, payload`` (JSON text).
    """
    return rows.select("archive_id", "table", "row_hash",
                       (F.sha2("payload", 256) == F.col("row_hash")).alias("hash_ok"),
                       F.col("payload").eqNullSafe(canon.jcs_any("payload")).alias("canonical_ok"))


def blob_integrity(blobs: DataFrame) -> DataFrame:
    """``blobs``: ``archive_id, hash`` (from the path) and ``content``, or its digest as ``sha256``.

    A blob that could not be read is not ok.
    """
    found = F.col("sha256") if "sha256" in blobs.columns else F.sha2("content", 256)
    return blobs.select("archive_id", "hash", F.coalesce(found == F.col("hash"), F.lit(False)).alias("ok"))


def blob_failures(evidence: DataFrame, checked: DataFrame) -> DataFrame:
    """Evidence whose blob is absent or hashes to something else."""
    return (evidence.select("archive_id", "hash").join(checked, ["archive_id", "hash"], "left")
            .filter(~F.coalesce("ok", F.lit(False)))
            .select("archive_id", "hash", F.when(F.col("ok").isNull(), F.lit("missing"))
                    .otherwise(F.lit("mismatch")).alias("failure")))


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("archive_id").agg(F.count("*").alias(name))


def verify_archive(archives: DataFrame, log: DataFrame, evidence: DataFrame, sources: DataFrame,
                   blobs: DataFrame, stored: DataFrame, stored_tables: DataFrame,
                   recomputed: DataFrame, recomputed_tables: DataFrame,
                   full: bool = True) -> DataFrame:
    """One row per archive and check: audit_chain, references, blobs, manifest."""
    text = lambda c: F.col(c).cast("string")
    base = archives.select("archive_id")

    chain = base.join(chains.verify_chain(log), "archive_id", "left").select(
        "archive_id", F.lit("audit_chain").alias("check"), F.coalesce("ok", F.lit(True)).alias("ok"),
        F.when(F.coalesce("ok", F.lit(True)), F.concat(
            F.coalesce(text("total_entries"), F.lit("0")), F.lit(" entries, chain valid")))
        .otherwise(F.concat(F.lit("BROKEN at seq="), text("first_failure_seq"), F.lit(": "),
                            F.col("first_failure_reason"))).alias("detail"))

    total = _count(evidence, "n")
    broken = _count(joins.broken_source_refs(evidence, sources), "bad")
    refs = (base.join(total, "archive_id", "left").join(broken, "archive_id", "left").fillna(0, ["n", "bad"])
            .select("archive_id", F.lit("references").alias("check"), (F.col("bad") == 0).alias("ok"),
                    F.concat(text("n"), F.lit(" evidence rows, "), text("bad"), F.lit(" broken refs"))
                    .alias("detail")))

    if full:
        state = evidence.select("archive_id", "hash").join(blob_integrity(blobs), ["archive_id", "hash"], "left")
        sums = state.groupBy("archive_id").agg(
            F.count("ok").alias("n"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("bad"))
        blob = base.join(sums, "archive_id", "left").fillna(0, ["n", "bad"]).select(
            "archive_id", F.lit("blobs").alias("check"), (F.col("bad") == 0).alias("ok"),
            F.concat(text("n"), F.lit(" blobs rehashed, "), text("bad"), F.lit(" mismatch")).alias("detail"))
    else:
        blob = base.select("archive_id", F.lit("blobs").alias("check"), F.lit(True).alias("ok"),
                           F.lit("skipped (--quick)").alias("detail"))

    differences = _count(sets.manifest_diff(stored, stored_tables, recomputed, recomputed_tables), "bad")
    present = stored.select("archive_id", F.lit(True).alias("present"))
    manifest = (base.join(present, "archive_id", "left").join(differences, "archive_id", "left")
                .fillna(0, ["bad"])
                .select("archive_id", F.lit("manifest").alias("check"),
                        (F.col("present").isNotNull() & (F.col("bad") == 0)).alias("ok"),
                        F.when(F.col("present").isNull(), F.lit("manifest.json missing"))
                        .when(F.col("bad") == 0, F.lit("stored content matches recomputed"))
                        .otherwise(F.concat(F.lit("stored manifest content DIVERGES from recomputed in "),
                                            text("bad"), F.lit(" fields"))).alias("detail")))
    return reduce(DataFrame.unionByName, [chain, refs, blob, manifest])


# --- derived artifacts ---------------------------------------------------------------------

_NAME = {"workspace": "workspace_id", "timeline": "timeline_id", "snapshot": "snapshot_id",
         "justification": "justification_id"}


def landed_headers(df: DataFrame, kind: str) -> DataFrame:
    """Header form of landed artifacts; ``decode_error`` rows keep their file name."""
    own = schemas.ARTIFACTS[kind][1]
    name = F.col(_NAME[kind]) if kind in _NAME else F.col("artifact_name")
    error = F.col("decode_error") if "decode_error" in df.columns else F.lit(None).cast("string")
    link = lambda c: F.col(c) if c in df.columns and c != own else F.lit(None).cast("string")
    return df.select(
        "archive_id", F.lit(kind).alias("artifact_kind"),
        F.coalesce(name, F.col("artifact_name") if "artifact_name" in df.columns else name).alias("artifact_id"),
        F.col(own).alias("declared_hash"), canon.self_hash(df, kind).alias("computed_hash"),
        link("workspace_hash").alias("workspace_hash"), link("timeline_hash").alias("timeline_hash"),
        link("source_manifest_hash").alias("source_manifest_hash"), error.alias("decode_error"))


def landed_references(df: DataFrame, kind: str) -> DataFrame:
    """What an artifact refers to: ``role, identifier`` per checked reference."""
    if kind in ("workspace", "snapshot"):
        column = "references" if kind == "workspace" else "referenced_artifacts"
        found = F.transform(column, lambda r: F.struct(r["reference_type"].alias("role"),
                                                       r["identifier"].alias("identifier")))
    elif kind == "timeline":
        found = F.transform("ordered_events", lambda e: F.struct(
            e["artifact_type"].alias("role"), e["artifact_identifier"].alias("identifier")))
    else:
        entries = F.flatten(F.array("minimal_evidence", "supporting_assessments", "provenance_chain"))
        found = F.concat(
            F.array(F.struct(F.lit("conclusion_anchor").alias("role"),
                             F.col("conclusion_anchor_id").alias("identifier"))),
            F.transform(entries, lambda e: F.struct(e["entry_role"].alias("role"),
                                                    e["entry_identifier"].alias("identifier"))))
    return df.select("archive_id", F.lit(kind).alias("artifact_kind"), F.col(_NAME[kind]).alias("artifact_id"),
                     F.explode(found).alias("r")).select("archive_id", "artifact_kind", "artifact_id", "r.*")


def _short(c: str) -> Column:
    return F.concat(F.substring(c, 1, 8), F.lit("..."))


def _quoted(c: str) -> Column:
    return F.concat(F.lit("'"), F.col(c), F.lit("'"))


def _issue(df: DataFrame, kind: str, detail: Column) -> DataFrame:
    return df.select("archive_id", "artifact_kind", "artifact_id", F.lit(kind).alias("issue_kind"),
                     detail.alias("detail"))


def header_issues(headers: DataFrame, manifests: DataFrame) -> DataFrame:
    """Decode errors, hash mismatches, manifest drift and broken links."""
    good = headers.filter("decode_error IS NULL")
    hashes = headers.filter("decode_error IS NULL").select(
        "archive_id", "artifact_kind", F.col("declared_hash").alias("known_hash"))

    def link(column: str, target: str, kinds: list[str], issue: str) -> DataFrame:
        known = hashes.filter(F.col("artifact_kind") == target).select(
            "archive_id", F.col("known_hash").alias(column))
        loose = good.filter(F.col("artifact_kind").isin(kinds) & F.col(column).isNotNull()).join(
            known, ["archive_id", column], "left_anti")
        return _issue(loose, issue, F.concat(F.lit(f"{column} "), _short(column),
                                             F.lit(f" not in <archive>/{target}s/")))

    wrong = good.filter(F.col("declared_hash") != F.col("computed_hash"))
    mismatch = wrong.select(
        "archive_id", "artifact_kind", "artifact_id",
        F.when(F.col("artifact_kind") == "attestation", F.lit("attestation_hash_mismatch"))
        .otherwise(F.lit("hash_mismatch")).alias("issue_kind"),
        F.concat("artifact_kind", F.lit("_hash recompute mismatch")).alias("detail"))
    drift = good.filter(F.col("artifact_kind") == "justification").join(
        manifests.select("archive_id", F.col("manifest_hash").alias("current")), "archive_id").filter(
        F.col("source_manifest_hash") != F.col("current"))
    return reduce(DataFrame.unionByName, [
        _issue(headers.filter("decode_error IS NOT NULL"), "decode_error",
               F.concat(F.lit("decode failed: "), F.col("decode_error"))),
        mismatch,
        _issue(drift, "manifest_drift", F.concat(F.lit("source_manifest_hash "),
               _short("source_manifest_hash"), F.lit(" != current "), _short("current"))),
        link("workspace_hash", "workspace", ["timeline", "snapshot", "justification"], "workspace_link_broken"),
        link("timeline_hash", "timeline", ["snapshot"], "timeline_link_broken")])


def reference_issues(references: DataFrame, evidence: DataFrame, sources: DataFrame,
                     assessments: DataFrame, provenance: DataFrame) -> DataFrame:
    """References without a row; custody steps are looked up by evidence only.

    All ids go into one keyed frame, so the references are shuffled once and met by
    a single anti join, whatever their role.
    """
    role, name = F.col("role"), F.col("identifier")
    step = role == "provenance_step"
    formed = F.contains(name, F.lit("__step"))
    noun = (F.when(role == "evidence", F.lit("evidence"))
            .when(role.isin("assessment", "conclusion_anchor"), F.lit("assessment"))
            .when((role == "source") & (F.col("artifact_kind") == "justification"), F.lit("source"))
            .when(step & formed, F.lit("provenance")))
    wanted = references.withColumn("noun", noun).withColumn(
        "wanted_id", F.when(step, F.substring_index(name, "__step", 1)).otherwise(name))

    def known(df: DataFrame, label: str, column: str) -> DataFrame:
        return df.select("archive_id", F.lit(label).alias("noun"), F.col(column).alias("wanted_id"))

    rows = reduce(DataFrame.unionByName, [
        known(evidence, "evidence", "hash"), known(sources, "source", "id"),
        known(assessments, "assessment", "assessment_id"), known(provenance, "provenance", "evidence_hash")])
    # Malformed steps have no noun and so never match.
    loose = wanted.filter(F.col("noun").isNotNull() | step).join(
        rows, ["archive_id", "noun", "wanted_id"], "left_anti")
    quoted = _quoted("identifier")
    detail = (F.when(step & ~formed, F.concat(F.lit("provenance_step identifier malformed: "), quoted))
              .when(step, F.concat(F.lit("provenance row for "), _short("wanted_id"), F.lit(" not found")))
              .when(role == "conclusion_anchor", F.concat(F.lit("conclusion_anchor_id "), quoted, F.lit(" not found")))
              .when(F.col("artifact_kind") == "timeline", F.concat(F.lit("event references "), "noun", F.lit(" "), quoted))
              .when(F.col("artifact_kind") == "justification",
                    F.concat(F.lit("chain entry references "), "noun", F.lit(" "), quoted))
              .otherwise(F.concat("noun", F.lit(" "), quoted, F.lit(" not found"))))
    issue = F.when(step, F.lit("provenance_step_dangling")).otherwise(
        F.concat("noun", F.lit("_reference_dangling")))
    return loose.select("archive_id", "artifact_kind", "artifact_id", issue.alias("issue_kind"), detail.alias("detail"))


def artifact_index(headers: DataFrame, assessments: DataFrame) -> DataFrame:
    """``archive_id, artifact_kind, artifact_id, self_hash`` of all that should be logged."""
    return (headers.filter("decode_error IS NULL")
            .select("archive_id", "artifact_kind", "artifact_id", F.col("declared_hash").alias("self_hash"))
            .unionByName(assessments.select("archive_id", F.lit("assessment").alias("artifact_kind"),
                                            F.col("assessment_id").alias("artifact_id"),
                                            F.col("evidence_id").alias("self_hash"))))


def reconcile(index: DataFrame, log: DataFrame) -> DataFrame:
    """Artifacts against the newest log entry of each: missing on either side, or differing."""
    kinds = F.create_map(*[F.lit(x) for kv in schemas.DERIVED_ACTIONS.items() for x in kv])
    newest = aggregates.latest_by_target(log).select(
        "archive_id", F.regexp_replace("target", "^[A-Za-z][A-Za-z0-9]*:", "").alias("path"), "target",
        F.element_at(kinds, F.col("action")).alias("logged_kind"),
        F.coalesce(F.element_at("parameters", "self_hash"), F.lit("")).alias("logged_hash"))
    logged_archives = log.select("archive_id").distinct()
    here = index.join(logged_archives, "archive_id", "left_semi").withColumn(
        "path", F.concat_ws("/", "artifact_kind", "artifact_id"))
    both = here.join(newest, ["archive_id", "path"], "full_outer")
    issue = (F.when(F.col("target").isNull(), F.lit("missing_audit_entry"))
             .when(F.col("artifact_id").isNull(), F.lit("missing_persisted_artifact"))
             .when(F.col("logged_hash") != F.col("self_hash"), F.lit("audit_log_hash_mismatch")))
    detail = (F.when(F.col("target").isNull(), F.concat(
                  F.lit("target "), _quoted("path"), F.lit(" present on disk but no audit entry references it")))
              .when(F.col("artifact_id").isNull(), F.concat(
                  F.lit("audit log references "), _quoted("path"),
                  F.lit(" but no persisted artifact found at canonical location")))
              .otherwise(F.concat(F.lit("last entry declares self_hash "), _short("logged_hash"),
                                  F.lit(" but disk has "), _short("self_hash"))))
    own_id = F.regexp_replace("path", "^[^/]*/", "")
    return both.select("archive_id", F.coalesce("artifact_kind", "logged_kind").alias("artifact_kind"),
                       F.coalesce("artifact_id", own_id).alias("artifact_id"), issue.alias("issue_kind"),
                       detail.alias("detail")).filter("issue_kind IS NOT NULL")


def derived_integrity(headers: DataFrame, references: DataFrame, evidence: DataFrame, sources: DataFrame,
                      assessments: DataFrame, provenance: DataFrame, manifests: DataFrame,
                      log: DataFrame) -> DataFrame:
    """Every issue of every derived artifact; thirteen kinds."""
    return reduce(DataFrame.unionByName, [
        header_issues(headers, manifests),
        reference_issues(references, evidence, sources, assessments, provenance),
        reconcile(artifact_index(headers, assessments), log)]).select(*ISSUE)


# --- loose artifact files ------------------------------------------------------------------


def _text_without(schema: T.StructType, own: str) -> Column:
    """Canonical text of the record in ``text`` without one field.

    Written as a lambda over a single element so that the text is parsed once
    instead of once per field.
    """
    fields = [f for f in schema.fields if f.name != own]
    parsed = F.array(F.from_json("text", schema))
    return F.element_at(F.transform(parsed, lambda r: canon.canonical_struct(
        {f.name: (r[f.name], f.dataType) for f in fields})), 1)


def verify_artifacts(texts: DataFrame, manifests: DataFrame | None = None,
                     workspace_hashes: DataFrame | None = None,
                     timeline_hashes: DataFrame | None = None) -> DataFrame:
    """Kind, self-hash verdict and drift of artifact JSON of unknown kind.

    ``texts``: ``archive_id, artifact_name, text``; hash frames have ``archive_id, hash``.
    """
    rows = texts.select("archive_id", "artifact_name", "text", ids.detect_kind(F.col("text")).alias("kind"))
    declared = computed = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, _ in schemas.KIND_KEYS:
        schema, own = schemas.ARTIFACTS[kind]
        here = F.col("kind") == kind
        computed = computed.when(here, F.sha2(_text_without(schema, own), 256))
        declared = declared.when(here, F.get_json_object("text", f"$.{own}"))
    out = rows.select(
        "archive_id", "artifact_name", "kind", declared.alias("declared_hash"), computed.alias("computed_hash"),
        *[F.get_json_object("text", f"$.{c}").alias(c)
          for c in ("source_manifest_hash", "workspace_hash", "timeline_hash")])
    out = out.withColumn("self_hash_ok", F.col("declared_hash") == F.col("computed_hash"))
    if manifests is not None:
        out = out.join(manifests.select("archive_id", F.col("manifest_hash").alias("current")),
                       "archive_id", "left").withColumn(
            "manifest_drift", F.coalesce(F.col("source_manifest_hash") != F.col("current"), F.lit(False))
        ).drop("current")
    for column, known in (("workspace_hash", workspace_hashes), ("timeline_hash", timeline_hashes)):
        if known is not None:
            found = known.select("archive_id", F.col("hash").alias(column), F.lit(True).alias("found")).distinct()
            out = out.join(found, ["archive_id", column], "left").withColumn(
                f"{column}_unknown", F.col(column).isNotNull() & F.col("found").isNull()).drop("found")
    return out.drop("source_manifest_hash", "workspace_hash", "timeline_hash")
