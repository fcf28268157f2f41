"""One registered query per operator, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlens import schemas
from provlens.functions import canonical as canon
from provlens.functions import identifiers as ids
from provlens.operators import (aggregates, artifacts, chains, filters, graph, joins, media, proofs, sets)
from provlens.plans import ingest as ingesting
from provlens.plans import report, verify
from provlens.session import ensure_checkpoint_dir
from provlens.sources import readers, writers
from provlens.streaming import chain_state, streams
from provlens.workload.sqlworld import (CERT, ZERO, arr, entry_text, iso, lit, manifest_text, n, obj, q, s, sn,
                                        with_world)
from provlens.workload.world import World, sha

Query = Callable[[World], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_world(sql)
        return fn

    return register


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def text(c: str | Column) -> Column:
    return ids.iso_second(F.col(c) if isinstance(c, str) else c)


# --- scans and sinks -----------------------------------------------------------------------


@query("src_1_scan_table", f"""SELECT ev.archive_id, ev.hash AS row_id, r.row_hash, kind, mime_type, size_bytes,
 source_id, {iso("ingested_at")} AS ingested_at FROM ev JOIN rhash r ON r.archive_id = ev.archive_id
 AND r.row_id = ev.hash AND r.tbl = 'evidence'""")
def _(w):
    # Each record is a Parquet file of its own, as archives store them.
    root = scratch(w.spark, "tables")
    writers.write_rows(w.payload(w.evidence, "evidence", "hash"), root)
    return readers.scan_table(w.spark, root, "evidence").select(
        "archive_id", "row_id", "row_hash", "kind", "mime_type", "size_bytes", "source_id",
        text("ingested_at").alias("ingested_at"))


@query("src_2_lookup", "SELECT archive_id, id, name, jurisdiction FROM src WHERE id = 'src0'")
def _(w):
    return readers.lookup(w.sources, "id", "src0").select("archive_id", "id", "name", "jurisdiction")


@query("src_3_upsert", """SELECT archive_id, hash, sha256(source_id) AS row_hash, source_id FROM (
 SELECT *, row_number() OVER (PARTITION BY archive_id, hash ORDER BY doc_id DESC) AS rn FROM docs) x WHERE rn = 1""")
def _(w):
    columns = ("archive_id", "hash", sha(F.col("source_id")).alias("row_hash"), "source_id")
    return writers.upsert(w.evidence.select(*columns), w.documents.select(*columns, "doc_id"),
                          ["archive_id", "hash"], ["doc_id"])


@query("src_4_scan_blobs", """SELECT archive_id, hash, octet_length(encode(text)) + CASE WHEN doc_id % 7 = 3 THEN 1 ELSE 0 END AS size_bytes,
 doc_id % 7 <> 3 AS intact FROM ev JOIN documents d USING (doc_id) WHERE hash IS NOT NULL""")
def _(w):
    # Every record's text is a file under its hash; some were changed, and others have no blob's name.
    root = scratch(w.spark, "blobs")
    content = F.concat("text", F.when(F.col("doc_id") % 7 == 3, F.lit("!")).otherwise(F.lit("")))
    blobs = w.evidence.filter("hash IS NOT NULL").select("archive_id", "hash", "doc_id").join(w.table("documents").select("doc_id", "text"), "doc_id")
    named = F.concat(F.lit("objects/sha256/"), F.substring("hash", 1, 2), F.lit("/"), F.expr("substring(hash, 3)"))
    strays = [(F.concat(named, F.lit(".part")), "text"), (F.concat(F.lit("objects/sha256/"), "hash"), "text")]
    every_tenth = blobs.filter("doc_id % 10 = 0")
    for path, body in strays:
        writers.write_files(every_tenth.select("archive_id", path.alias("path"), F.col(body).alias("content")), root)
    writers.write_files(blobs.select("archive_id", named.alias("path"), content.alias("content")), root)
    found = readers.scan_blobs(w.spark, root, digest=True)
    return found.select("archive_id", "hash", "size_bytes", (F.col("sha256") == F.col("hash")).alias("intact"))


@query("src_5_scan_audit", f"""SELECT archive_id, pos, pos AS seq, event_type AS action, timestamp, cents
 FROM ebase""")
def _(w):
    from provlens.functions.ordered import sequenced
    # Write the logs as line files per archive, 10,000 lines in each, in order, and read them back.
    root = scratch(w.spark, "logs")
    entries = w.events.withColumn("seq", F.lit(0).cast("long")).withColumn(
        "prev_hash", F.lit(schemas.ZERO_HASH)).withColumn("entry_hash", F.lit(schemas.ZERO_HASH))
    line = F.to_json(F.struct(*[f.name for f in schemas.AUDIT_ENTRY.fields]))
    # Events of no user lie in a folder named as Spark names it.
    owner = F.coalesce("archive_id", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("archive_id")
    lines = sequenced(entries.select(owner, "ts", "event_id", line.alias("value")), ["archive_id"], ["ts", "event_id"])
    parts = lines.groupBy("archive_id", F.floor(F.col("position") / 10_000).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("position", "value"))).alias("lines"))
    writers.write_files(parts.select(
        "archive_id", F.format_string("part-%012d", "part").alias("path"),
        F.concat(F.array_join(F.col("lines.value"), "\n"), F.lit("\n")).alias("content")), root)
    read = readers.scan_audit(w.spark, root, pattern="")
    return read.select("archive_id", "pos", F.col("pos").alias("seq"), "action", "timestamp",
                       F.element_at("parameters", "cents").alias("cents"))


@query("src_6_scan_artifacts", """SELECT archive_id, assessment_id AS justification_id, justification_hash,
 n_steps AS steps, true AS intact FROM just""")
def _(w):
    # Written as lines, and again as files: named by id, or hidden names, and some that are empty or no JSON.
    root = scratch(w.spark, "artifacts")
    writers.write_artifacts(w.justifications, "justification", root)
    lines = readers.scan_artifacts(w.spark, root, "justification", pattern="", lines=True)
    named = w.justifications.withColumn("name", F.concat(
        F.when(F.col("justification_id") < "8", F.lit("_")).otherwise(F.lit("")), "justification_id"))
    files = scratch(w.spark, "artifacts")
    writers.write_artifact_files(named, "justification", readers.ARTIFACT_DIRS["justification"], "name", files)
    for name, body in (("empty", ""), (".cut", "{")):
        path = F.concat(F.lit(f"{readers.ARTIFACT_DIRS['justification']}/{name}-"), "id", F.lit(".json"))
        writers.write_files(w.sources.select("archive_id", path.alias("path"), F.lit(body).alias("content")), files)
    read = readers.scan_artifacts(w.spark, files, "justification")
    # Each broken file is reported: none is left after one was taken off for each that was written.
    broken = (read.filter("decode_error IS NOT NULL").groupBy("archive_id").count()
              .join(w.sources.groupBy("archive_id").agg((2 * F.count("*")).alias("made")), "archive_id", "full"))
    every = broken.filter("NOT (count <=> made)").select("archive_id", F.lit("unreported").alias("justification_id"), F.lit("").alias("justification_hash"),
                                                         F.lit(0).alias("steps"), F.lit(False).alias("intact"))
    intact = (canon.self_hash(read, "justification") == F.col("justification_hash"))
    out = read.filter("decode_error IS NULL").select(
        "archive_id", "justification_id", "justification_hash",
        F.size("provenance_chain").alias("steps"), intact.alias("intact"))
    same = lines.select("archive_id", "justification_id", F.col("justification_hash").alias("line_hash"))
    return (out.join(same, ["archive_id", "justification_id"], "full")
            .withColumn("intact", F.col("intact") & (F.col("line_hash") == F.col("justification_hash"))).drop("line_hash")
            .unionByName(every))


@query("src_7_scan_manifest", """SELECT archive_id, tbl AS "table", row_count, schema_hash, sha256(hashes)
 AS partition_digest FROM tman""")
def _(w):
    # A manifest file per archive; broken ones stand beside them in archives of their own.
    root = scratch(w.spark, "manifests")
    lists = w.rows.groupBy("archive_id", "table").agg(F.array_sort(F.collect_list("row_hash")).alias("h"))
    tables = aggregates.table_counts(w.rows, w.archives).join(lists, ["archive_id", "table"], "left")
    entry = F.struct(F.coalesce("h", F.array().cast("array<string>")).alias("partition_hashes"), "row_count", "schema_hash")
    body = F.to_json(F.struct(F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), F.lit("2024-01-01T00:00:00Z").alias("generated_at"),
                              F.map_from_entries(F.collect_list(F.struct("table", entry))).alias("tables")))
    stored = tables.groupBy("archive_id").agg(body.alias("content"))
    broken = stored.select(F.concat("archive_id", F.lit("-broken")).alias("archive_id"), F.expr("substring(content, 2)").alias("content"))
    writers.write_files(stored.unionByName(broken).withColumn("path", F.lit("manifest.json")), root)
    return readers.scan_manifest(w.spark, root)[1]


@query("src_8_scan_transparency", """SELECT archive_id, sequence, manifest_hash, audit_entry_count, signed_at, operator_id,
 previous_manifest_hash FROM man""")
def _(w):
    # One numbered file per manifest; other names in the folder, and what is no JSON, don't count.
    root = scratch(w.spark, "log")
    body = F.to_json(F.struct(*[f.name for f in schemas.TRANSPARENCY.fields]))
    at = F.format_string("transparency/manifest-%06d.json", F.col("sequence"))
    good = w.manifests.select("archive_id", at.alias("path"), body.alias("content"))
    strays = w.manifests.filter("sequence % 5 = 0").select(
        "archive_id", F.explode(F.array(F.format_string("transparency/manifest-%d.json.bak", F.col("sequence")), F.lit("transparency/latest.json"),
                                        F.format_string("transparency/old/manifest-%06d.json", F.col("sequence")))).alias("path"), body.alias("content"))
    torn = w.manifests.filter("sequence % 5 = 1").select(
        "archive_id", F.format_string("transparency/manifest-9%06d.json", F.col("sequence")).alias("path"), F.lit("{").alias("content"))
    for files in (strays.dropDuplicates(["archive_id", "path"]), torn, good):
        writers.write_files(files, root)
    return readers.scan_transparency(w.spark, root).select(
        "archive_id", "sequence", "manifest_hash", "audit_entry_count", "signed_at", "operator_id", "previous_manifest_hash")


@query("src_9_scan_witnesses", """SELECT archive_id, sequence, attestation_hash, source_id AS witness_operator_id FROM wit""")
def _(w):
    root = scratch(w.spark, "witnesses")
    body = F.to_json(F.struct(*[f.name for f in schemas.WITNESS.fields]))
    at = F.format_string("transparency/witnesses/manifest-%06d/%s.json", F.col("target_manifest_sequence"), F.col("attestation_hash"))
    good = w.witnesses.select("archive_id", at.alias("path"), body.alias("content"))
    bad = w.manifests.select("archive_id", F.explode(F.array(
        F.format_string("transparency/witnesses/manifest-%06d/%s.json", F.col("sequence"), F.col("manifest_hash")),
        F.format_string("transparency/witnesses/manifest-%06d/note.json", F.col("sequence")))).alias("path"), F.lit("[]").alias("content"))
    for files in (good, bad):
        writers.write_files(files, root)
    return readers.scan_witnesses(w.spark, root).select("archive_id", "sequence", "attestation_hash", "witness_operator_id")


@query("src_10_scan_sidecars", """SELECT archive_id, certificate_hash, source_id AS operator_id, captured_at, device_id,
 toxic = 0 AS intact FROM cert""")
def _(w):
    root = scratch(w.spark, "sidecars")
    folder = readers.SIDECAR_DIRS["certificate"]
    writers.write_artifact_files(w.certificates, "certificate", folder, "certificate_hash", root)
    for name, body in (("empty", ""), ("_list", "[]")):
        writers.write_files(w.archives.select("archive_id", F.lit(f"{folder}/{name}.json").alias("path"), F.lit(body).alias("content")), root)
    read = readers.scan_sidecars(w.spark, root, "certificate")
    return read.select("archive_id", "certificate_hash", "operator_id", "captured_at", "device_id",
                       (canon.self_hash(read, "certificate") == F.col("certificate_hash")).alias("intact"))


@query("src_11_write_artifacts", f"SELECT archive_id, {obj({**CERT, 'certificate_hash': s('certificate_hash'), 'notes': sn('note')})} AS value FROM (SELECT *, CASE WHEN toxic = 1 THEN 'edited' END AS note FROM cert) x")
def _(w):
    return writers.artifact_lines(w.certificates, "certificate")


@query("src_12_export_log_index", """SELECT m.archive_id, m.sequence, printf('manifest-%06d.json', m.sequence) AS filename, m.manifest_hash, m.audit_entry_count, m.signed_at, count(w.sequence) AS witness_count
 FROM man m LEFT JOIN wit w ON w.archive_id = m.archive_id AND w.sequence = m.sequence GROUP BY ALL""")
def _(w):
    index = writers.export_log_index(w.manifests, w.witnesses)
    return index.select("archive_id", "sequence", "filename", "manifest_hash", "audit_entry_count", "signed_at",
                        "witness_count")


@query("src_12_log_index_totals", """SELECT archive_id, count(*) AS manifest_count, sum(c) AS total_witnesses,
 sum(CASE WHEN c > 0 THEN 1 ELSE 0 END) AS manifests_with_witnesses, max(sequence) AS head_sequence,
 arg_max(manifest_hash, sequence) AS head_hash FROM (SELECT m.archive_id, m.sequence, m.manifest_hash,
 count(w.sequence) AS c FROM man m LEFT JOIN wit w ON w.archive_id = m.archive_id AND w.sequence = m.sequence
 GROUP BY ALL) x GROUP BY archive_id""")
def _(w):
    return writers.log_index_totals(writers.export_log_index(w.manifests, w.witnesses)).drop(
        "notarized_count", "anchored_count")


# --- projections, filters, rules -----------------------------------------------------------


@query("flt_1_list_evidence", f"""SELECT archive_id, hash, kind, mime_type, size_bytes,
 {iso("ingested_at")} AS ingested_at, ingested_by, source_id FROM ev""")
def _(w):
    return filters.list_evidence(w.evidence).withColumn("ingested_at", text("ingested_at"))


@query("flt_2_search_evidence", """SELECT archive_id, hash, kind, source_id FROM ev WHERE kind = 'still_image'
 AND (contains(hash, 'src1') OR contains(lower(kind), 'src1') OR contains(lower(mime_type), 'src1')
 OR contains(lower(ingested_by), 'src1') OR contains(lower(source_id), 'src1'))""")
def _(w):
    return filters.search_evidence(w.evidence, "SRC1", "still_image").select(
        "archive_id", "hash", "kind", "source_id")


@query("flt_3_filter_audit", """SELECT archive_id, event_type AS action, 'prov:event/' || event_id AS target, timestamp
 FROM ebase WHERE event_type = 'purchase'""")
def _(w):
    return filters.filter_audit(w.events, "purchase").select("archive_id", "action", "target", "timestamp")


@query("flt_4_search_manifests", """SELECT archive_id, sequence, manifest_hash, CASE
 WHEN starts_with(manifest_hash, p) THEN 'manifest_hash' WHEN starts_with(previous_manifest_hash, p)
 THEN 'previous_manifest_hash' WHEN starts_with(audit_chain_head_hash, p) THEN 'audit_chain_head_hash'
 ELSE 'public_key_fingerprint' END AS matched_field FROM (SELECT *, substr(sha256('m:en:2'), 1, 8) AS p FROM man) x
 WHERE starts_with(manifest_hash, p) OR starts_with(previous_manifest_hash, p)
 OR starts_with(audit_chain_head_hash, p) OR starts_with(public_key_fingerprint, p)""")
def _(w):
    import hashlib
    prefix = hashlib.sha256(b"m:en:2").hexdigest()[:8]
    return filters.search_manifests(w.manifests, prefix.upper()).select(
        "archive_id", "sequence", "manifest_hash", "matched_field")


def spoiled_evidence(w: World) -> DataFrame:
    """Evidence with a fault per kind of row."""
    c = F.col
    return (w.evidence
            .withColumn("content_uri", F.when(c("kind") == "still_image", F.replace("content_uri", F.lit("/"), F.lit("\\")))
                        .otherwise(c("content_uri")))
            .withColumn("hash", F.when(c("source_id") == "src3", F.upper("hash")).otherwise(c("hash")))
            .withColumn("mime_type", F.when(c("archive_id") == "de", F.lit("")).otherwise(c("mime_type")))
            .withColumn("size_bytes", F.when(c("source_id") == "src5", -c("size_bytes")).otherwise(c("size_bytes"))))


@query("flt_5_validate_rows_evidence", """SELECT archive_id, CASE WHEN source_id = 'src3' THEN upper(hash) ELSE hash END
 AS row_id, rule FROM (SELECT archive_id, hash, source_id, 'content_uri_posix' AS rule FROM ev WHERE kind = 'still_image'
 UNION ALL SELECT archive_id, hash, source_id, 'hash_format' FROM ev WHERE source_id = 'src3'
 UNION ALL SELECT archive_id, hash, source_id, 'mime_type_filled' FROM ev WHERE archive_id = 'de'
 UNION ALL SELECT archive_id, hash, source_id, 'size_not_negative' FROM ev WHERE source_id = 'src5') x""")
def _(w):
    return filters.validate_rows(spoiled_evidence(w), "evidence")


@query("flt_5_validate_rows_audit", """SELECT archive_id, cast(pos AS varchar) AS row_id, 'action_known' AS rule
 FROM ebase UNION ALL SELECT archive_id, cast(pos AS varchar), 'entry_hash_format' FROM ebase
 WHERE event_type = 'error'""")
def _(w):
    # Event types are no known actions; hashes of errors are cut short.
    from provlens.functions.ordered import sequenced
    rows = sequenced(w.events, ["archive_id"], ["ts", "event_id"])
    spoiled = F.when(F.col("action") == "error", F.lit("00")).otherwise(F.lit(schemas.ZERO_HASH))
    return filters.validate_rows(rows.withColumn("seq", F.col("position")).withColumn(
        "prev_hash", F.lit(schemas.ZERO_HASH)).withColumn("entry_hash", spoiled).withColumn(
        "timestamp", F.date_trunc("second", "ts")), "audit_log")


@query("flt_5_validate_rows_provenance", """SELECT archive_id, hash AS row_id, rule FROM (
 SELECT archive_id, hash, 'complete_without_gaps' AS rule FROM prov WHERE n_steps = 2
 UNION ALL SELECT archive_id, hash, 'origin_source_id_filled' FROM prov WHERE origin_source_id = 'ghost') x""")
def _(w):
    return filters.validate_rows(
        w.provenance.withColumn("is_complete", F.size("steps") == 2).withColumn(
            "origin_source_id", F.regexp_replace("origin_source_id", "^ghost$", "")), "provenance")


@query("flt_6_validate_artifacts", """SELECT archive_id, assessment_id AS row_id, 'entries_sorted' AS rule FROM just
 WHERE n_steps = 2 OR supporting IS NOT NULL""")
def _(w):
    turned = w.justifications
    for c in ("minimal_evidence", "provenance_chain"):
        turned = turned.withColumn(c, F.reverse(c))
    return filters.validate_artifacts(turned, "justification")


@query("flt_7_source_conflicts", """SELECT archive_id, id, 'name' AS field, 'Source ' || id || '!' AS provided,
 name AS stored FROM src WHERE id = 'src4' UNION ALL SELECT archive_id, id, 'jurisdiction', 'FR', jurisdiction FROM src
 WHERE jurisdiction <> 'FR' UNION ALL SELECT archive_id, id, 'license', 'CC0', NULL FROM src WHERE id = 'src6'""")
def _(w):
    incoming = w.sources.select(
        "archive_id", "id", F.when(F.col("id") == "src4", F.concat("name", F.lit("!"))).alias("name"),
        F.lit(None).cast("string").alias("kind"), "authority", F.lit("FR").alias("jurisdiction"),
        F.when(F.col("id") == "src6", F.lit("CC0")).alias("license"))
    return filters.source_conflicts(incoming, w.sources)


@query("flt_8_validate_transparency", """SELECT archive_id, cast(sequence AS varchar) AS row_id, rule FROM (
 SELECT archive_id, sequence, 'bootstrap_previous_is_zero' AS rule FROM man WHERE sequence = 0 AND archive_id = 'fr'
 UNION ALL SELECT archive_id, sequence, 'signature_format' FROM man WHERE archive_id = 'de') x""")
def _(w):
    return filters.validate_transparency(
        w.manifests.withColumn("previous_manifest_hash", F.when(F.col("archive_id") == "fr", F.col("manifest_hash"))
                               .otherwise(F.col("previous_manifest_hash")))
        .withColumn("signature", F.when(F.col("archive_id") == "de", F.lit("zz")).otherwise(F.col("signature"))))


@query("flt_8_validate_certificates", """SELECT archive_id, certificate_hash AS row_id, 'notes_filled_or_null' AS rule
 FROM cert WHERE toxic = 1 UNION ALL SELECT archive_id, certificate_hash, 'captured_at_format' FROM cert
 WHERE archive_id = 'es'""")
def _(w):
    return filters.validate_certificates(
        w.certificates.withColumn("notes", F.regexp_replace("notes", "edited", "")).withColumn(
            "captured_at", F.when(F.col("archive_id") == "es", F.replace("captured_at", F.lit("T"), F.lit(" ")))
            .otherwise(F.col("captured_at"))))


@query("flt_8_validate_witnesses", """SELECT archive_id, attestation_hash AS row_id, 'target_operator_id_filled' AS rule
 FROM wit WHERE source_id = 'src19'""")
def _(w):
    return filters.validate_witnesses(w.witnesses.withColumn(
        "target_operator_id", F.regexp_replace("target_operator_id", "^someone$", "")))


@query("flt_9_list_artifacts", """SELECT archive_id, assessment_id AS id, justification_hash FROM just""")
def _(w):
    return filters.list_artifacts(w.justifications, "justification")


@query("flt_9_list_log_manifests", """SELECT archive_id, sequence, manifest_hash, previous_manifest_hash,
 audit_chain_head_hash, audit_entry_count, audit_entry_count AS evidence_count, 0 AS attestation_count, signed_at,
 operator_id, public_key_fingerprint FROM man""")
def _(w):
    return filters.list_artifacts(w.manifests, "transparency_manifest")


# --- joins ---------------------------------------------------------------------------------


@query("join_1_evidence_view", """SELECT ev.archive_id, ev.hash, ev.kind, src.name AS source_name,
 p.origin_source_id, p.n_steps AS step_count, a.assessment_id, a.status FROM ev
 JOIN src ON src.archive_id = ev.archive_id AND src.id = ev.source_id
 LEFT JOIN prov p ON p.archive_id = ev.archive_id AND p.hash = ev.hash
 LEFT JOIN asm a ON a.archive_id = ev.archive_id AND a.evidence_id = ev.hash""")
def _(w):
    first = F.try_element_at("assessments", F.lit(1))
    return joins.evidence_view(w.evidence, w.sources, w.provenance, w.assessments).select(
        "archive_id", "hash", "kind", F.col("source.name").alias("source_name"),
        "provenance.origin_source_id", F.size("provenance.steps").alias("step_count"),
        first["assessment_id"].alias("assessment_id"), first["status"].alias("status"))


@query("join_2_broken_source_refs", """SELECT ev.archive_id, ev.hash, ev.source_id FROM ev LEFT JOIN src
 ON src.archive_id = ev.archive_id AND src.id = ev.source_id WHERE src.id IS NULL""")
def _(w):
    return joins.broken_source_refs(w.evidence, w.sources).select("archive_id", "hash", "source_id")


@query("join_3_missing_blobs", """SELECT archive_id, hash FROM ev WHERE NOT EXISTS (SELECT 1 FROM lab
 WHERE lab.archive_id = ev.archive_id AND lab.hash = ev.hash AND quality IS NOT NULL)""")
def _(w):
    return joins.missing_blobs(w.evidence, w.labelled.filter("quality IS NOT NULL"))


@query("join_4_assess", """SELECT archive_id, assessment_id, evidence_id, created_at, 'provenance_review' AS method,
 status, rationale, coalesce(supporting, '') AS supporting FROM asm""")
def _(w):
    made = joins.assess(w.evidence, w.sources, w.provenance, F.col("ingested_at") + F.expr("INTERVAL 1 HOUR"))
    return made.select("archive_id", "assessment_id", "evidence_id", text("created_at").alias("created_at"),
                                "method", "status", "rationale",
                                F.array_join("supporting_source_ids", ",").alias("supporting"))


@query("join_5_audit_entry_of", """SELECT archive_id, hash, seq, timestamp, actor, entry_hash FROM ilog""")
def _(w):
    return joins.audit_entry_of(w.evidence, w.ingest_log).drop("parameters")


@query("join_6_coverage", """SELECT i.archive_id, i.hash, i.seq, count(m.sequence) AS covering_manifests,
 min(m.sequence) AS first_sequence, arg_min(m.manifest_hash, m.sequence) AS first_manifest_hash,
 min(m.signed_at) AS first_signed_at, min(m.audit_entry_count) AS least_count FROM ilog i LEFT JOIN man m ON m.archive_id = i.archive_id
 AND m.audit_entry_count > i.seq GROUP BY 1, 2, 3""")
def _(w):
    entries = joins.audit_entry_of(w.evidence, w.ingest_log)
    return joins.coverage(entries, w.manifests)


@query("join_7_proofs_citing", """SELECT archive_id, hash, proof_id, matched_premise_id, sha256('proof:' || proof_id)
 AS proof_hash, 1 AS inference_count, 1 AS weak_inference_count, 'q0' AS conclusion_claim_id FROM cref""")
def _(w):
    return proofs.proofs_citing(w.evidence, w.case_proofs).select(
        "archive_id", "hash", "proof_id", "matched_premise_id", "proof_hash", "inference_count",
        "weak_inference_count", "conclusion_claim_id")


@query("join_8_certificate_of", """SELECT p.archive_id, p.hash, c.certificate_hash, c.source_id AS operator_id,
 c.captured_at, c.device_id FROM prov p JOIN cert c ON c.archive_id = p.archive_id AND c.hash = p.hash
 WHERE p.n_steps > 0""")
def _(w):
    return joins.certificate_of(w.provenance, w.certificates).select(
        "archive_id", "hash", "certificate_hash", "operator_id", "captured_at", "device_id")


@query("join_9_certificate_binding", """SELECT c.archive_id, CASE WHEN c.source_id = 'src2' THEN sha256(c.hash)
 ELSE c.hash END AS hash, certificate_hash, CASE WHEN toxic = 1 THEN 'tampered' WHEN c.source_id = 'src2'
 THEN 'other_blob' ELSE 'bound' END AS binding FROM cert c""")
def _(w):
    submitted = w.certificates.select(
        "archive_id", "certificate_hash",
        F.when(F.col("operator_id") == "src2", sha(F.col("evidence_sha256"))).otherwise(F.col("evidence_sha256"))
        .alias("hash"))
    return joins.certificate_binding(submitted, w.certificates)


@query("join_10_witness_target", """SELECT archive_id, attestation_hash, source_id AS witness_operator_id,
 sequence AS target_manifest_sequence, true AS target_found, source_id NOT IN ('src7', 'src19') AS target_ok FROM wit""")
def _(w):
    return joins.witness_target(w.witnesses, w.manifests)


@query("join_11_case_view", """SELECT w.archive_id, w.workspace_id, title, workspace_hash, reference_count AS
 evidence_count, max(j.assessment_id) AS justification_id, 1 AS timeline_count, true AS has_timeline FROM ws w
 LEFT JOIN asm j ON j.archive_id = w.archive_id AND j.archive_id || '.' || j.source_id = w.workspace_id GROUP BY ALL""")
def _(w):
    heads, refs = w.workspaces
    of = refs.filter("reference_type = 'assessment'").join(heads, ["archive_id", "workspace_id"]).select(
        "archive_id", F.col("identifier").alias("justification_id"), "workspace_hash")
    lines = heads.select("archive_id", "workspace_hash")
    return joins.case_view(heads, of, lines)


_DECLARED = """SELECT archive_id, 'witness' AS role, id AS owner_id, sha256('key:' || id) AS fp FROM src
 WHERE id <> 'src5' UNION ALL SELECT archive_id, 'operator', 'operator-' || archive_id,
 sha256('key:operator-' || CASE archive_id WHEN 'de' THEN 'xx' ELSE archive_id END) FROM arch"""
_PRESENT = """SELECT archive_id, 'witness' AS role, sha256('key:' || source_id) AS fp FROM (SELECT DISTINCT archive_id,
 source_id FROM lab WHERE quality = 1) x UNION ALL SELECT archive_id, 'operator',
 sha256('key:operator-' || archive_id) FROM arch"""
_STATES = f"""SELECT coalesce(d.archive_id, p.archive_id) AS archive_id, coalesce(d.role, p.role) AS role,
 coalesce(d.fp, p.fp) AS public_key_fingerprint, owner_id, CASE WHEN d.fp IS NULL THEN 'extra' WHEN p.fp IS NULL
 THEN 'missing' ELSE 'matched' END AS state FROM ({_DECLARED}) d FULL OUTER JOIN ({_PRESENT}) p
 ON p.archive_id = d.archive_id AND p.role = d.role AND p.fp = d.fp"""


def key_states(w: World) -> DataFrame:
    """Sources but one are declared; those with good evidence have a key; one operator changed keys."""
    a = F.col("archive_id")
    declared = w.sources.filter("id <> 'src5'").select(
        "archive_id", F.lit("witness").alias("role"), F.col("id").alias("owner_id"),
        sha("key:", F.col("id")).alias("public_key_fingerprint")).unionByName(w.archives.select(
            "archive_id", F.lit("operator").alias("role"), F.concat(F.lit("operator-"), a).alias("owner_id"),
            sha("key:operator-", F.when(a == "de", F.lit("xx")).otherwise(a)).alias("public_key_fingerprint")))
    present = w.labelled.filter("quality = 1").select("archive_id", "source_id").distinct().select(
        "archive_id", F.lit("witness").alias("role"),
        sha("key:", F.col("source_id")).alias("public_key_fingerprint")).unionByName(w.archives.select(
            "archive_id", F.lit("operator").alias("role"), sha("key:operator-", a).alias("public_key_fingerprint")))
    return joins.key_consistency(declared, present)


@query("join_12_key_consistency", _STATES)
def _(w):
    return key_states(w)


@query("join_12_key_summary", f"""SELECT archive_id, bool_or(role = 'operator' AND state = 'matched') AS operator_matches,
 count(*) FILTER (role = 'witness' AND state <> 'extra') AS witnesses_declared,
 count(*) FILTER (role = 'witness' AND state = 'missing') AS witnesses_without_key,
 count(*) FILTER (role = 'witness' AND state = 'extra') AS keys_not_declared FROM ({_STATES}) x GROUP BY 1""")
def _(w):
    return joins.key_summary(key_states(w))


def headers(w: World) -> DataFrame:
    """An 80-byte block header per order, in hex."""
    key = F.col("o_orderkey").cast("string")
    return w.table("orders").select(
        F.col("o_orderkey").alias("height"),
        F.concat(F.substring(sha("v", key), 1, 8), sha("p", key), F.upper(sha("m", key)),
                 F.substring(sha("t", key), 1, 24)).alias("header_hex"))


@query("join_13_anchor_match", """SELECT l_orderkey AS height, l_linenumber AS line, max(l_partkey) AS part,
 o.o_orderkey IS NOT NULL AND l_returnflag <> 'R' AS anchored FROM lineitem LEFT JOIN orders o
 ON o.o_orderkey = l_orderkey GROUP BY l_orderkey, l_linenumber, l_returnflag, o.o_orderkey""")
def _(w):
    key = F.col("l_orderkey").cast("string")
    claims = w.table("lineitem").groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(
        F.max("l_partkey").alias("part")).select(
        F.col("l_orderkey").alias("height"), F.col("l_linenumber").alias("line"), "part",
        F.when(F.col("l_returnflag") == "R", sha("x", key)).otherwise(sha("m", key)).alias("merkle_root"))
    return joins.anchor_match(claims, headers(w)).select("height", "line", "part", "anchored")


_FOOT = """SELECT archive_id, CASE WHEN id = 'src9' THEN 'ipns' WHEN id > 'src3' THEN 'https_pem'
 ELSE 'github_user_keys' END AS kind, 'https://keys.example/' || id AS uri, sha256('key:' || id) AS declared_fingerprint,
 CASE WHEN id = 'src9' THEN 'unsupported' WHEN id = 'src8' THEN 'unreachable' WHEN jurisdiction = 'ES'
 THEN 'mismatch' ELSE 'verified' END AS status FROM (SELECT archive_id, id, jurisdiction FROM src) x"""


def footprints(w: World) -> DataFrame:
    """Keys published per source; Spanish archives declare another key than the published one."""
    i, spanish = F.col("id"), F.col("jurisdiction") == "ES"
    kind = (F.when(i == "src9", "ipns").when(i > "src3", "https_pem").otherwise("github_user_keys"))
    uri = F.concat(F.lit("https://keys.example/"), i)
    references = w.sources.select("archive_id", kind.alias("kind"), uri.alias("uri"),
                                  F.when(spanish, sha("other:", i)).otherwise(sha("key:", i)).alias("declared_fingerprint"))
    fetched = w.sources.filter("id <> 'src8'").select(
        kind.alias("kind"), uri.alias("uri"),
        F.array(sha("old:", i), sha("key:", i)).alias("fingerprints")).distinct()
    return joins.footprint_status(references, fetched)


@query("join_14_footprint_status", f"SELECT archive_id, kind, uri, status FROM ({_FOOT}) f")
def _(w):
    return footprints(w).select("archive_id", "kind", "uri", "status")


@query("join_14_footprint_counts", f"""SELECT archive_id, count(*) FILTER (status = 'verified') AS verified_count,
 count(*) FILTER (status = 'mismatch') AS mismatch_count, count(*) FILTER (status IN ('verified', 'mismatch'))
 AS reachable_count, count(*) FILTER (status <> 'unsupported') AS supported_count FROM ({_FOOT}) f GROUP BY 1""")
def _(w):
    return joins.footprint_counts(footprints(w))


@query("join_15_report_data", f"""SELECT ev.archive_id, ev.hash, ev.kind, ev.size_bytes, src.name AS source_name,
 coalesce(p.n_steps, 0) AS step_count, i.seq, i.entry_hash, cv.n AS covering_manifests, coalesce(cv.w, 0)
 AS covering_witnesses, cv.first_sequence, CASE WHEN r.hash IS NULL THEN 0 ELSE 1 END AS proof_count,
 CASE WHEN p.n_steps > 0 THEN c.certificate_hash END AS certificate_hash FROM ev
 JOIN src ON src.archive_id = ev.archive_id AND src.id = ev.source_id
 LEFT JOIN prov p ON p.archive_id = ev.archive_id AND p.hash = ev.hash
 LEFT JOIN ilog i ON i.archive_id = ev.archive_id AND i.hash = ev.hash
 LEFT JOIN cref r ON r.archive_id = ev.archive_id AND r.hash = ev.hash
 LEFT JOIN cert c ON c.archive_id = ev.archive_id AND c.hash = ev.hash
 LEFT JOIN (SELECT i.archive_id, i.seq, count(m.sequence) AS n, sum(t.c) AS w, min(m.sequence) AS first_sequence
 FROM ilog i JOIN man m ON m.archive_id = i.archive_id AND m.audit_entry_count > i.seq
 LEFT JOIN (SELECT archive_id, sequence, count(*) AS c FROM wit GROUP BY 1, 2) t
 ON t.archive_id = m.archive_id AND t.sequence = m.sequence GROUP BY 1, 2) cv
 ON cv.archive_id = i.archive_id AND cv.seq = i.seq""")
def _(w):
    return report.report_data(w.evidence, w.sources, w.provenance, w.assessments, w.ingest_log, w.manifests,
                              w.witnesses, w.case_proofs, w.certificates).select(
        "archive_id", "hash", "kind", "size_bytes", "source_name", "step_count", "seq", "entry_hash",
        "covering_manifests", "covering_witnesses", "first_sequence", "proof_count", "certificate_hash")


@query("join_16_signer_known", """SELECT archive_id, attestation_hash, sha256('key:' || source_id) IN
 (SELECT public_key_fingerprint FROM keys) AS signer_known FROM wit""")
def _(w):
    return joins.signer_known(w.witnesses, w.landed_keys, "witness_public_key_fingerprint").select(
        "archive_id", "attestation_hash", "signer_known")


# --- aggregates ----------------------------------------------------------------------------


@query("agg_1_table_manifest", """SELECT archive_id, tbl AS "table", row_count, schema_hash, sha256(hashes)
 AS partition_digest FROM tman""")
def _(w):
    return aggregates.table_manifest(w.rows, w.archives)


@query("agg_2_blobs_root", "SELECT archive_id, blobs_root FROM broot")
def _(w):
    return aggregates.blobs_root(w.evidence, w.archives)


@query("agg_3_archive_manifest", "SELECT archive_id, blobs_root, manifest_hash FROM am")
def _(w):
    return aggregates.archive_manifest(w.rows, w.evidence, w.archives, "0.1.0").select(
        "archive_id", "blobs_root", "manifest_hash")


@query("agg_4_archive_counts", """SELECT a.archive_id, sha256('am:' || a.archive_id) AS archive_manifest_hash,
 i.head AS audit_chain_head_hash, i.total AS audit_entry_count, i.total AS evidence_count, 0 AS attestation_count,
 x.c AS workspace_count, 0 AS timeline_count, 0 AS snapshot_count, i.total AS justification_count FROM arch a
 JOIN (SELECT archive_id, arg_max(entry_hash, seq) AS head, count(*) AS total FROM ilog GROUP BY 1) i
 ON i.archive_id = a.archive_id JOIN (SELECT archive_id, count(DISTINCT source_id) AS c FROM ev GROUP BY 1) x
 ON x.archive_id = a.archive_id""")
def _(w):
    heads = chains.chain_head(w.ingest_log)
    return aggregates.archive_counts(w.current_manifests, heads, evidence=w.evidence,
                                     workspace=w.workspace_inputs[0], justification=w.justifications)


@query("agg_5_action_counts", "SELECT archive_id, event_type AS action, count(*) AS count FROM ebase GROUP BY 1, 2")
def _(w):
    return aggregates.action_counts(w.events)


@query("agg_6_kind_counts", """SELECT archive_id, kind, count(*) AS count FROM ev GROUP BY 1, 2 UNION ALL
 SELECT archive_id, '*', count(*) FROM ev GROUP BY 1""")
def _(w):
    return aggregates.kind_counts(w.evidence)


_CONCLUSION = """CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 'contaminated' WHEN quality = 0 THEN 'unexplained'
 WHEN n_chars < 1000 THEN 'indeterminate' ELSE 'explained' END"""


@query("agg_7_case_state_counts", f"""SELECT archive_id, count(*) FILTER (c IS NULL) AS open,
 count(*) FILTER (c = 'explained') AS explained, count(*) FILTER (c = 'unexplained') AS unexplained,
 count(*) FILTER (c = 'indeterminate') AS indeterminate, count(*) FILTER (c = 'contaminated') AS contaminated
 FROM (SELECT archive_id, {_CONCLUSION} AS c FROM lab) x GROUP BY 1""")
def _(w):
    return aggregates.case_state_counts(w.labelled.withColumn("conclusion", F.expr(_CONCLUSION)))


_IMPACT = """SELECT archive_id, node_kind AS root_kind, node_id AS root_id, root_kind AS node_kind, root_id AS node_id,
 distance FROM up WHERE EXISTS (SELECT 1 FROM nodes WHERE nodes.archive_id = up.archive_id AND nodes.kind = up.node_kind
 AND nodes.id = up.node_id)"""


@query("agg_8_impact_summary", f"""SELECT archive_id, root_kind, root_id,
 count(*) FILTER (node_kind = 'assessment') AS affected_assessments,
 count(*) FILTER (node_kind = 'evidence') AS affected_evidence, max(distance) AS dependency_depth_max,
 count(*) AS total_affected_nodes FROM ({_IMPACT}) i GROUP BY 1, 2, 3""")
def _(w):
    nodes, edges = w.graph
    return aggregates.impact_summary(graph.impact(nodes, edges, nodes))


@query("agg_9_proof_structure", """SELECT h.archive_id, h.proof_id, 1 AS premise_count, count(s.inference_id)
 AS inference_count, count(s.inference_id) AS derived_claim_count,
 count(*) FILTER (s.rule = 'abduction_to_best_explanation') AS weak_rule_uses,
 count(*) FILTER (s.rule = 'modus_ponens') AS modus_ponens FROM (SELECT DISTINCT archive_id, proof_id FROM turns) h
 LEFT JOIN psteps s USING (archive_id, proof_id) GROUP BY 1, 2""")
def _(w):
    out = proofs.proof_structure(w.proofs)
    used = F.coalesce(F.try_element_at("rules_used", F.lit("modus_ponens")), F.lit(0))
    return out.withColumn("modus_ponens", used).drop("rules_used")


@query("agg_10_latest_by_target", """SELECT archive_id, event_type AS target, max(pos) AS seq,
 arg_max(cents, pos) AS self_hash FROM ebase GROUP BY 1, 2""")
def _(w):
    from provlens.functions.ordered import sequenced
    rows = sequenced(w.events, ["archive_id"], ["ts", "event_id"])
    derived = rows.select("archive_id", F.col("position").alias("pos"), F.col("position").alias("seq"),
                          F.col("action").alias("target"), F.lit("build_workspace").alias("action"),
                          F.create_map(F.lit("self_hash"), F.element_at("parameters", "cents")).alias("parameters"))
    return aggregates.latest_by_target(derived).select(
        "archive_id", "target", "seq", F.element_at("parameters", "self_hash").alias("self_hash"))


def ingest_mentions(w: World, name: Column | None = None, size: Column | None = None) -> DataFrame:
    """Every document as an ingest entry, copies included."""
    return w.documents.select(
        "archive_id" if name is None else name.alias("archive_id"), F.col("doc_id").alias("pos"),
        F.lit("ingest_evidence").alias("action"), ids.evidence_uri(F.col("hash")).alias("target"),
        F.create_map(F.lit("size_bytes"), (F.col("size_bytes") if size is None else size).cast("string"),
                     F.lit("source"), F.col("source_id")).alias("parameters"))


@query("agg_11_latest_ingest", """SELECT archive_id, hash, cast(arg_max(size_bytes, doc_id) AS varchar) AS size_bytes,
 arg_max(source_id, doc_id) AS source FROM docs GROUP BY 1, 2""")
def _(w):
    out = aggregates.latest_ingest(ingest_mentions(w))
    return out.select("archive_id", "hash", F.element_at("parameters", "size_bytes").alias("size_bytes"),
                      F.element_at("parameters", "source").alias("source"))


@query("agg_13_header_consensus", """SELECT l_orderkey AS height, count(DISTINCT l_suppkey % 40) AS sources, CASE
 WHEN min(l_returnflag) <> max(l_returnflag) THEN 'disagreement' WHEN count(DISTINCT l_suppkey % 40) < 2 THEN 'too_few_sources'
 ELSE 'agreed' END AS status FROM lineitem GROUP BY 1""")
def _(w):
    # Every line of an order reports a header for it; return flags make them differ. Few sources, so some
    # report a height twice.
    rows = w.table("lineitem").select(F.col("l_orderkey").alias("height"), (F.col("l_suppkey") % 40).alias("source"),
                                      sha(F.col("l_orderkey").cast("string"), F.col("l_returnflag")).alias("header_hex"))
    return aggregates.header_consensus(rows, 2).select("height", "sources", "status")


@query("agg_14_witness_totals", "SELECT archive_id, sequence, count(*) AS witness_count FROM wit GROUP BY 1, 2")
def _(w):
    return aggregates.witness_totals(w.witnesses)


@query("agg_14_witness_summary", """SELECT archive_id, count(*) AS total_witnesses, count(DISTINCT sequence)
 AS manifests_with_witnesses FROM wit GROUP BY 1""")
def _(w):
    return aggregates.witness_summary(aggregates.witness_totals(w.witnesses))


@query("agg_15_timeline_bounds", f"""SELECT archive_id, min(timestamp) AS first_timestamp, max(timestamp) AS
 last_timestamp, count(*) AS event_count FROM ebase GROUP BY 1""")
def _(w):
    return aggregates.timeline_bounds(w.events.withColumn("observed_at", F.col("timestamp")), ["archive_id"])


@query("agg_16_log_status", """SELECT archive_id, count(*) AS manifest_count, max(hour) - min(hour) + 1 - count(*)
 AS gap_count, max(hour) - min(hour) + 1 = count(*) AS ok, max(hour) AS sequence, arg_max(manifest_hash, hour)
 AS manifest_hash, arg_max(signed_at, hour) AS signed_at FROM man GROUP BY 1""")
def _(w):
    # Numbered by hour of day count, so hours without ingests are gaps.
    numbered = w.manifests.drop("sequence").join(
        w._hours.select("archive_id", "hour", sha("m:", F.col("archive_id"), ":", F.col("sequence").cast("string"))
                        .alias("manifest_hash")), ["archive_id", "manifest_hash"]).withColumnRenamed("hour", "sequence")
    return aggregates.log_status(numbered).select("archive_id", "manifest_count", "gap_count", "ok", "sequence",
                                                  "manifest_hash", "signed_at")


def trust(w: World) -> DataFrame:
    return report.trust_timeline(w.evidence, w.provenance, w.ingest_log, w.manifests, w.case_proofs, w.certificates)


@query("agg_17_layer_counts", """SELECT ev.archive_id, ev.hash, CASE WHEN p.n_steps > 0 THEN 1 ELSE 0 END AS capture,
 1 AS ingest, 1 AS manifest, 1 AS proof, CASE WHEN p.n_steps > 0 THEN 4 ELSE 3 END AS active_layers FROM ev
 LEFT JOIN prov p ON p.archive_id = ev.archive_id AND p.hash = ev.hash""")
def _(w):
    return aggregates.layer_counts(trust(w))


# --- chains and order ----------------------------------------------------------------------


@query("win_1_chain_links", """SELECT archive_id, pos, seq, expected_seq, expected_prev_hash,
 computed_hash = entry_hash AS hash_ok FROM tlink""")
def _(w):
    return chains.chain_links(w.tampered_log).select(
        "archive_id", "pos", "seq", "expected_seq", "expected_prev_hash",
        (F.col("computed_hash") == F.col("entry_hash")).alias("hash_ok"))


_REASON = """CASE WHEN seq <> expected_seq THEN 'seq mismatch at entry ' || seq || ': expected seq=' || expected_seq || '.'
 WHEN prev_hash <> expected_prev_hash THEN 'prev_hash mismatch at seq=' || seq || ': expected ' ||
 substr(expected_prev_hash, 1, 8) || '…, found ' || substr(prev_hash, 1, 8) || '….'
 WHEN computed_hash <> entry_hash THEN 'entry_hash mismatch at seq=' || seq || ': stored ' || substr(entry_hash, 1, 8) ||
 '…, recomputed ' || substr(computed_hash, 1, 8) || '….' END"""


@query("win_2_verify_chain", f"""SELECT archive_id, count(reason) = 0 AS ok, count(*) AS total_entries,
 arg_min(CASE WHEN reason IS NOT NULL THEN seq END, CASE WHEN reason IS NOT NULL THEN pos END) AS first_failure_seq,
 arg_min(reason, CASE WHEN reason IS NOT NULL THEN pos END) AS first_failure_reason
 FROM (SELECT *, {_REASON} AS reason FROM tlink) x GROUP BY 1""")
def _(w):
    return chains.verify_chain(w.tampered_log)


@query("win_3_verify_chain_all", f"""SELECT archive_id, seq, reason FROM (
 SELECT archive_id, seq, 'sequence break: expected ' || (pos + start) || ', got ' || seq AS reason FROM (SELECT *,
 min(seq) OVER (PARTITION BY archive_id) AS start FROM tlink) a WHERE seq <> pos + start
 UNION ALL SELECT archive_id, seq, 'entry_hash mismatch' FROM tlink WHERE computed_hash <> entry_hash
 UNION ALL SELECT archive_id, seq, 'prev_hash does not match entry_hash of seq ' || (expected_seq - 1) FROM tlink
 WHERE pos > 0 AND prev_hash <> expected_prev_hash
 UNION ALL SELECT archive_id, seq, 'bootstrap entry (seq=0) must have prev_hash = 0*64' FROM tlink
 WHERE pos = 0 AND seq = 0 AND prev_hash <> '{ZERO}') x""")
def _(w):
    return chains.verify_chain_all(w.tampered_log)


@query("win_4_verify_transparency_chain", f"""SELECT archive_id, count(*) AS manifest_count, count(reason) = 0 AS ok,
 arg_min(reason, CASE WHEN reason IS NOT NULL THEN idx END) AS reason FROM (SELECT *, CASE
 WHEN sequence <> idx THEN 'sequence mismatch at index ' || idx || ': expected ' || idx || ', got ' || sequence
 WHEN sha256({manifest_text("previous_manifest_hash")}) <> manifest_hash
 THEN 'manifest at sequence ' || sequence || ' failed structural verification'
 WHEN previous_manifest_hash <> before THEN 'chain break' END AS reason FROM (SELECT *,
 row_number() OVER v - 1 AS idx, coalesce(lag(manifest_hash) OVER v, '{ZERO}') AS before FROM cman
 WINDOW v AS (PARTITION BY archive_id ORDER BY sequence)) x) y GROUP BY 1""")
def _(w):
    return chains.verify_transparency_chain(w.chained_manifests)


@query("win_5_chain_head", """SELECT archive_id, arg_max(entry_hash, seq) AS head_hash, count(*) AS total FROM ilog
 GROUP BY 1""")
def _(w):
    return chains.chain_head(w.ingest_log, w.archives)


@query("win_6_append_chain", "SELECT archive_id, pos, seq, prev_hash, entry_hash FROM elog")
def _(w):
    return chains.append_chain(None, w.events.drop("value"), ["ts", "event_id"]).select(
        "archive_id", "pos", "seq", "prev_hash", "entry_hash")


@query("win_7_rank_events", """SELECT archive_id, event_type AS kind, event_id, row_number() OVER
 (PARTITION BY archive_id ORDER BY timestamp, sha256(cast(event_id AS varchar))) - 1 AS position FROM ebase""")
def _(w):
    events = w.events.select(
        "archive_id", F.col("action").alias("artifact_type"), F.col("event_id").cast("string").alias("artifact_identifier"),
        sha(F.col("event_id").cast("string")).alias("artifact_hash"), F.col("timestamp").alias("observed_at"),
        F.lit("event.ts").alias("source_reference"))
    return chains.rank_events(events, ["archive_id"]).select(
        "archive_id", F.col("artifact_type").alias("kind"),
        F.col("artifact_identifier").cast("long").alias("event_id"), "position")


@query("win_8_dedupe_first", "SELECT archive_id, hash, doc_id, source_id, size_bytes FROM ev")
def _(w):
    return chains.dedupe_first(w.documents, ["archive_id", "hash"], ["doc_id"]).select(
        "archive_id", "hash", "doc_id", "source_id", "size_bytes")


@query("win_9_next_sequence", """SELECT archive_id, max(sequence) + 1 AS next_sequence,
 arg_max(manifest_hash, sequence) AS previous_manifest_hash FROM man GROUP BY 1""")
def _(w):
    return chains.next_sequence(w.manifests)


@query("ord_1_canonical_edges", "SELECT archive_id, kind, src_kind, src_id, dst_kind, dst_id FROM edges")
def _(w):
    return chains.canonical_edges(w.graph[1])


@query("ord_1_canonical_nodes", "SELECT archive_id, kind, id FROM nodes")
def _(w):
    return chains.canonical_nodes(w.graph[0])


@query("ord_2_page", """SELECT archive_id, seq AS pos, hash, total FROM (SELECT *, count(*) OVER (PARTITION BY archive_id)
 AS total FROM ilog) x WHERE seq BETWEEN 20 AND 69""")
def _(w):
    return chains.page(w.ingest_log, 20, 50).select("archive_id", "pos", ids.uri_hash(F.col("target")).alias("hash"),
                                                    "total")


@query("ord_3_list_assessments", "SELECT archive_id, assessment_id, status FROM asm")
def _(w):
    return chains.list_assessments(w.assessments).select("archive_id", "assessment_id", "status")


@query("ord_4_head_manifest", """SELECT archive_id, max(sequence) AS sequence, arg_max(manifest_hash, sequence)
 AS manifest_hash, arg_max(signed_at, sequence) AS signed_at FROM man GROUP BY 1""")
def _(w):
    return chains.head_manifest(w.manifests).select("archive_id", "sequence", "manifest_hash", "signed_at")


# --- set operations ------------------------------------------------------------------------


_SNAP = """SELECT DISTINCT archive_id, 'evidence' AS reference_type, hash AS identifier,
 sha256('evidence:' || hash) AS artifact_hash FROM docs"""


def snapshot_sides(w: World) -> tuple[DataFrame, DataFrame]:
    """References to the documents with and those without a label; copies lie in both."""
    rows = w.documents.join(w.table("labels").select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left").select(
        "archive_id", F.lit("evidence").alias("reference_type"), F.col("hash").alias("identifier"),
        ids.ref_hash(F.lit("evidence"), F.col("hash")).alias("artifact_hash"), "labelled")
    return rows.filter("labelled").drop("labelled"), rows.filter("labelled IS NULL").drop("labelled")


_SIDES = """SELECT archive_id, hash, bool_or(l.doc_id IS NOT NULL) AS in_a, bool_or(l.doc_id IS NULL) AS in_b
 FROM docs LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id) GROUP BY 1, 2"""
_CHANGES = f"""SELECT archive_id, 'evidence' AS reference_type, hash AS identifier, sha256('evidence:' || hash)
 AS artifact_hash, CASE WHEN NOT in_a THEN 'added' WHEN NOT in_b THEN 'removed' ELSE 'unchanged' END AS change
 FROM ({_SIDES}) z"""


@query("set_1_snapshot_diff", _CHANGES)
def _(w):
    return sets.snapshot_diff(*snapshot_sides(w), ["archive_id"])


def _diff_items(change: str) -> str:
    item = obj({"reference_type": s("reference_type"), "identifier": s("identifier"), "artifact_hash": s("artifact_hash")})
    return f"('[' || coalesce(string_agg({item}, ',' ORDER BY identifier) FILTER (change = '{change}'), '') || ']')"


@query("set_1_snapshot_diff_hash", f"""SELECT archive_id, sha256({obj({
    "added_artifacts": "a", "removed_artifacts": "r", "unchanged_artifacts": "u", "schema_version": q("1"),
    "snapshot_a_hash": s("sha256('a' || archive_id)"), "snapshot_b_hash": s("sha256('b' || archive_id)")})}) AS diff_hash
 FROM (SELECT archive_id, {_diff_items("added")} AS a, {_diff_items("removed")} AS r, {_diff_items("unchanged")} AS u
 FROM ({_CHANGES}) c GROUP BY 1) x""")
def _(w):
    changes = sets.snapshot_diff(*snapshot_sides(w), ["archive_id"])
    headers_ = w.archives.select("archive_id", sha("a", F.col("archive_id")).alias("snapshot_a_hash"),
                                 sha("b", F.col("archive_id")).alias("snapshot_b_hash"))
    return sets.snapshot_diff_hash(changes, headers_, ["archive_id"]).select("archive_id", "diff_hash")


@query("set_2_justification_diff", """SELECT archive_id, assessment_id, role AS entry_role, name AS entry_identifier,
 CASE WHEN role = 'provenance_step' THEN 'removed' ELSE 'unchanged' END AS change FROM (
 SELECT archive_id, assessment_id, 'evidence' AS role, evidence_id AS name FROM j0 UNION ALL
 SELECT archive_id, assessment_id, 'source', supporting FROM j0 WHERE supporting IS NOT NULL UNION ALL
 SELECT archive_id, assessment_id, 'assessment', assessment_id FROM j0 UNION ALL
 SELECT archive_id, assessment_id, 'graph_node', 'evidence:' || evidence_id FROM j0 UNION ALL
 SELECT archive_id, assessment_id, 'graph_node', 'source:' || source_id FROM j0 UNION ALL
 SELECT archive_id, assessment_id, 'provenance_step', evidence_id || '__step00001' FROM j0 WHERE n_steps >= 1 UNION ALL
 SELECT archive_id, assessment_id, 'provenance_step', evidence_id || '__step00002' FROM j0 WHERE n_steps = 2) x""")
def _(w):
    keys = ["archive_id", "justification_id"]
    full = w.justifications
    bare = full.withColumn("provenance_chain", F.filter("provenance_chain", lambda e: F.lit(False)))
    out = sets.justification_diff(sets.justification_entries(full, keys), sets.justification_entries(bare, keys), keys)
    return out.select("archive_id", F.col("justification_id").alias("assessment_id"), "entry_role", "entry_identifier",
                      "change")


def archive_sides(w: World) -> tuple[DataFrame, DataFrame]:
    """Labelled documents against the others; the second archive counted characters as bytes."""
    labelled = w.table("labels").select("doc_id", F.lit("a").alias("side"))
    rows = w.documents.join(labelled, "doc_id", "left")
    a, b = rows.filter("side = 'a'"), rows.filter("side IS NULL")

    def newest(df: DataFrame, size: str) -> DataFrame:
        return aggregates.latest_ingest(df.select(
            F.lit("x").alias("archive_id"), F.col("doc_id").alias("pos"), F.lit("ingest_evidence").alias("action"),
            ids.evidence_uri(F.col("hash")).alias("target"),
            F.create_map(F.lit("size_bytes"), F.col(size).cast("string")).alias("parameters")))

    return newest(a, "size_bytes"), newest(b, "n_chars")


@query("set_3_compare_archives", """SELECT coalesce(a.hash, b.hash) AS hash, CASE WHEN b.hash IS NULL THEN 'a_only'
 WHEN a.hash IS NULL THEN 'b_only' ELSE 'shared' END AS presence, a.size = b.size AS parameters_match,
 coalesce(a.size <> b.size, false) AS has_divergence FROM
 (SELECT hash, max(size_bytes) AS size FROM docs JOIN labels USING (doc_id) GROUP BY 1) a FULL OUTER JOIN
 (SELECT hash, max(n_chars) AS size FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1) b
 ON a.hash = b.hash""")
def _(w):
    a, b = archive_sides(w)
    return sets.compare_archives(a, b).select("hash", "presence", "parameters_match", "has_divergence")


@query("set_4_compare_proofs", """SELECT proof_id, 'shared' AS presence, last_role <> 'user' AS matches
 FROM turns WHERE turn = 0""")
def _(w):
    # The other archive holds the same proofs, those ending on a user under a new hash.
    a = w.proofs.heads
    turns = w.table("conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role")).select(
        F.col("conv_id").cast("string").alias("proof_id"), "last_role")
    b = a.join(turns, "proof_id").withColumn("proof_hash", F.when(
        F.col("last_role") == "user", sha(F.col("proof_hash"))).otherwise(F.col("proof_hash")))
    return sets.compare_proofs(a, b).select("proof_id", "presence", "matches")


@query("set_5_manifest_diff", """SELECT archive_id, 'tables.' || tbl || '.row_count' AS field,
 cast(row_count + 1 AS varchar) AS stored, cast(row_count AS varchar) AS recomputed FROM tman WHERE tbl = 'evidence'
 UNION ALL SELECT archive_id, 'blobs_root', sha256(blobs_root), blobs_root FROM broot WHERE archive_id = 'fr'
 UNION ALL SELECT archive_id, 'tables.sources', 'absent', 'present' FROM arch WHERE archive_id = 'de'""")
def _(w):
    tables = aggregates.table_manifest(w.rows, w.archives)
    heads = aggregates.blobs_root(w.evidence, w.archives).withColumn(
        "schema_version", F.lit("0.1.0")).withColumn("notes", F.lit(None).cast("string"))
    stored = heads.withColumn("blobs_root", F.when(F.col("archive_id") == "fr", sha(F.col("blobs_root")))
                              .otherwise(F.col("blobs_root")))
    stored_tables = tables.withColumn("row_count", F.when(F.col("table") == "evidence", F.col("row_count") + 1)
                                      .otherwise(F.col("row_count"))).filter("NOT (archive_id = 'de' AND table = 'sources')")
    return sets.manifest_diff(stored, stored_tables, heads, tables)


@query("set_6_sequence_gaps", """SELECT archive_id, g AS missing_sequence FROM (SELECT archive_id,
 unnest(generate_series(lo, hi)) AS g FROM (SELECT archive_id, min(hour) AS lo, max(hour) AS hi FROM
 (SELECT DISTINCT archive_id, n_chars AS hour FROM ev) e GROUP BY 1) r) x
 WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.archive_id = x.archive_id AND ev.n_chars = x.g)""")
def _(w):
    return sets.sequence_gaps(w.evidence.select("archive_id", F.col("n_chars").alias("sequence")).distinct())


@query("set_7_duplicate_refs", """SELECT archive_id, 'evidence' AS reference_type, hash AS identifier, count(*) AS
 occurrences FROM docs GROUP BY 1, 3 HAVING count(*) > 1""")
def _(w):
    refs = w.documents.select("archive_id", F.lit("evidence").alias("reference_type"), F.col("hash").alias("identifier"))
    return sets.duplicate_refs(refs, ["archive_id"])


@query("set_8_compare_pairs", """SELECT 'labelled' AS archive_a, 'rest' AS archive_b, presence, count(*) AS records,
 count(*) FILTER (d) AS diverging FROM (SELECT CASE WHEN b.hash IS NULL THEN 'a_only' WHEN a.hash IS NULL THEN 'b_only'
 ELSE 'shared' END AS presence, coalesce(a.size <> b.size, false) AS d FROM
 (SELECT hash, max(size_bytes) AS size FROM docs JOIN labels USING (doc_id) GROUP BY 1) a FULL OUTER JOIN
 (SELECT hash, max(n_chars) AS size FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1) b
 ON a.hash = b.hash) x GROUP BY presence""")
def _(w):
    a, b = archive_sides(w)
    both = a.withColumn("archive_id", F.lit("labelled")).unionByName(b.withColumn("archive_id", F.lit("rest")))
    pairs = both.agg(F.min("archive_id").alias("archive_a"), F.max("archive_id").alias("archive_b"))
    return sets.compare_pairs(both, pairs).groupBy("archive_a", "archive_b", "presence").agg(
        F.count("*").alias("records"), F.count_if("has_divergence").alias("diverging"))


# --- scalar functions ----------------------------------------------------------------------


@query("fn_1_sha256_hex", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(w):
    return w.table("documents").select("doc_id", canon.sha256_hex(F.col("text")).alias("digest"))


@query("fn_2_canonical_text", f"""SELECT conv_id, turn, {obj({"conv_id": n("conv_id"), "role": s("role"),
       "text": "to_json(text)", "turn": n("turn")})} AS canonical FROM conversations""")
def _(w):
    t = w.table("conversations")
    return t.select("conv_id", "turn", canon.canonical_struct(
        {c: (F.col(c), t.schema[c].dataType) for c in t.columns}).alias("canonical"))


@query("fn_2_jcs_any", f"""SELECT page_id, {obj({"html": "to_json(html)", "page_id": n("page_id"),
       "url": "to_json(url)"})} AS canonical FROM pages""")
def _(w):
    # Keys out of order; the shape is not declared.
    t = w.table("pages")
    loose = F.to_json(F.struct("url", "page_id", "html"))
    return t.select("page_id", canon.jcs_any(loose).alias("canonical"))


@query("fn_3_hash_object", f"""SELECT event_id, sha256({obj({"event_id": n("event_id"), "event_type": s("event_type"),
       "props": "to_json(props)", "user_id": n("user_id")})}) AS digest FROM events""")
def _(w):
    t = w.table("events")
    return t.select("event_id", canon.hash_object(t, ["event_type", "user_id", "props", "event_id"]).alias("digest"))


@query("fn_4_self_hash", "SELECT archive_id, certificate_hash, toxic = 0 AS intact FROM cert")
def _(w):
    c = w.certificates
    return c.select("archive_id", "certificate_hash",
                    (canon.self_hash(c, "certificate") == F.col("certificate_hash")).alias("intact"))


_ATTESTED = {"artifact_kind": q("evidence"), "artifact_hash": s("hash"), "signer_id": s("'signer-' || source_id"),
             "public_key_fingerprint": s("sha256('key:' || source_id)"), "signature": s("sha256('a:' || hash) || sha256('b:' || hash)"),
             "signature_algorithm": q("ed25519"), "signed_at": s(iso("ingested_at")), "schema_version": q("1")}


@query("fn_4_self_hash_attestation", f"""SELECT archive_id, hash AS artifact_hash, sha256({obj(_ATTESTED)}) AS attestation_hash,
 doc_id % 9 <> 4 AS intact FROM ev WHERE hash IS NOT NULL""")
def _(w):
    # Of every ninth attestation the signer was changed after its hash was made.
    signer = F.concat(F.lit("signer-"), "source_id")
    made = w.evidence.filter("hash IS NOT NULL").select(
        "archive_id", "doc_id", F.lit("evidence").alias("artifact_kind"), F.col("hash").alias("artifact_hash"), signer.alias("signer_id"),
        sha("key:", F.col("source_id")).alias("public_key_fingerprint"), F.concat(sha("a:", F.col("hash")), sha("b:", F.col("hash"))).alias("signature"),
        F.lit("ed25519").alias("signature_algorithm"), text("ingested_at").alias("signed_at"), F.lit("1").alias("schema_version"))
    stored = made.withColumn("attestation_hash", canon.self_hash(made, "attestation")).withColumn(
        "signer_id", F.when(F.col("doc_id") % 9 == 4, F.lit("another")).otherwise(F.col("signer_id")))
    return stored.select("archive_id", "artifact_hash", "attestation_hash",
                         (canon.self_hash(stored, "attestation") == F.col("attestation_hash")).alias("intact"))


_PROOF = {"proof_type": q(f"{schemas.NAMESPACE}.justification.inference-proof.v1"), "schema_version": q("1"), "proof_id": s("'proof-' || doc_id"),
          "target_justification_id": s("'j-' || doc_id"), "target_justification_hash": s("sha256('j:' || doc_id)"), "conclusion_claim_id": q("c1"),
          "premises": "'[' || " + obj({"id": q("p1"), "text": s("'from ' || source_id"), "kind": q("observation"), "evidence_refs": f"'[' || {s('hash')} || ']'"}) + " || ']'",
          "inferences": "'[' || " + obj({"id": q("i1"), "rule": q("abduction_to_best_explanation"), "input_claim_ids": "'[\"p1\"]'", "output_claim_id": q("c1"),
                                        "text": "'\"é \\\"so\\\"\\n\"'"}) + " || ']'",
          "derived_claims": "'[' || " + obj({"id": q("c1"), "text": s("kind"), "inferred_by": q("i1")}) + " || ']'"}


@query("fn_4_self_hash_inference_proof", f"""SELECT archive_id, 'proof-' || doc_id AS proof_id, sha256({obj(_PROOF)}) AS proof_hash,
 doc_id % 9 <> 5 AS intact FROM ev WHERE hash IS NOT NULL""")
def _(w):
    # Of every ninth proof the rule was changed after its hash was made.
    def steps(rule):
        return F.array(F.struct(F.lit("i1").alias("id"), rule.alias("rule"), F.array(F.lit("p1")).alias("input_claim_ids"),
                                F.lit("c1").alias("output_claim_id"), F.lit('é "so"\n').alias("text")))

    number = F.col("doc_id").cast("string")
    made = w.evidence.filter("hash IS NOT NULL").select(
        "archive_id", "doc_id", F.lit(f"{schemas.NAMESPACE}.justification.inference-proof.v1").alias("proof_type"), F.lit("1").alias("schema_version"),
        F.concat(F.lit("proof-"), number).alias("proof_id"), F.concat(F.lit("j-"), number).alias("target_justification_id"),
        sha("j:", number).alias("target_justification_hash"),
        F.array(F.struct(F.lit("p1").alias("id"), F.concat(F.lit("from "), "source_id").alias("text"), F.array("hash").alias("evidence_refs"),
                         F.lit("observation").alias("kind"))).alias("premises"),
        steps(F.lit("abduction_to_best_explanation")).alias("inferences"),
        F.array(F.struct(F.lit("c1").alias("id"), F.col("kind").alias("text"), F.lit("i1").alias("inferred_by"))).alias("derived_claims"),
        F.lit("c1").alias("conclusion_claim_id"))
    stored = made.withColumn("proof_hash", canon.self_hash(made, "inference_proof")).withColumn(
        "inferences", steps(F.when(F.col("doc_id") % 9 == 5, F.lit("modus_ponens")).otherwise(F.lit("abduction_to_best_explanation"))))
    return stored.select("archive_id", "proof_id", "proof_hash",
                         (canon.self_hash(stored, "inference_proof") == F.col("proof_hash")).alias("intact"))


def _entry_sql(role: str, name: str) -> str:
    return "'[' || " + obj({"entry_role": q(role), "entry_identifier": s(name), "entry_hash": s(f"sha256('{role}:' || {name})")}) + " || ']'"


_JDIFF = {"justification_a_hash": s("sha256('ja:' || hash)"), "justification_b_hash": s("sha256('jb:' || hash)"), "removed_entries": "'[]'",
          "added_entries": _entry_sql("evidence", "hash"), "unchanged_entries": _entry_sql("source", "source_id"), "schema_version": q("1")}


@query("fn_4_self_hash_justification_diff", f"""SELECT archive_id, hash, sha256({obj(_JDIFF)}) AS diff_hash, doc_id % 9 <> 6 AS intact
 FROM ev WHERE hash IS NOT NULL""")
def _(w):
    # Of every ninth diff an entry was taken from one list to another after its hash was made.
    def entry(role, name):
        return F.array(F.struct(F.lit(role).alias("entry_role"), F.col(name).alias("entry_identifier"),
                                sha(f"{role}:", F.col(name)).alias("entry_hash")))

    none = F.array().cast("array<struct<entry_role: string, entry_identifier: string, entry_hash: string>>")
    made = w.evidence.filter("hash IS NOT NULL").select(
        "archive_id", "doc_id", "hash", sha("ja:", F.col("hash")).alias("justification_a_hash"), sha("jb:", F.col("hash")).alias("justification_b_hash"),
        entry("evidence", "hash").alias("added_entries"), none.alias("removed_entries"), entry("source", "source_id").alias("unchanged_entries"),
        F.lit("1").alias("schema_version"))
    moved = F.col("doc_id") % 9 == 6
    stored = made.withColumn("diff_hash", canon.self_hash(made, "justification_diff")).withColumn(
        "removed_entries", F.when(moved, F.col("added_entries")).otherwise(none)).withColumn(
        "added_entries", F.when(moved, none).otherwise(F.col("added_entries")))
    return stored.select("archive_id", "hash", "diff_hash",
                         (canon.self_hash(stored, "justification_diff") == F.col("diff_hash")).alias("intact"))


@query("fn_5_entry_hash", f"""SELECT archive_id, event_id, sha256({entry_text(lit(ZERO), seq="event_id")}) AS entry_hash
 FROM ebase""")
def _(w):
    rows = w.events.withColumn("seq", F.col("event_id")).withColumn("prev_hash", F.lit(schemas.ZERO_HASH))
    return rows.select("archive_id", "event_id", canon.entry_hash(rows).alias("entry_hash"))


@query("fn_6_ref_hash", "SELECT doc_id, sha256('evidence:' || hash) AS artifact_hash FROM docs")
def _(w):
    return w.documents.select("doc_id", ids.ref_hash(F.lit("evidence"), F.col("hash")).alias("artifact_hash"))


@query("fn_7_identifiers", """SELECT doc_id, hash || '__manual_research' AS assessment_id,
 hash || printf('__step%05d', n_chars) AS step_id FROM docs""")
def _(w):
    return w.documents.select(
        "doc_id", ids.assessment_id(F.col("hash"), F.lit("manual_research")).alias("assessment_id"),
        ids.step_id(F.col("hash"), F.col("n_chars")).alias("step_id"))


@query("fn_8_normalize_hash", """SELECT doc_id, CASE archive_id WHEN 'es' THEN NULL ELSE hash END AS hash FROM docs""")
def _(w):
    a, h = F.col("archive_id"), F.col("hash")
    given = (F.when(a == "en", h).when(a == "fr", F.concat(F.lit("sha256:"), h))
             .when(a == "de", ids.evidence_uri(h)).otherwise(F.upper(h)))
    return w.documents.select("doc_id", ids.normalize_hash(given).alias("hash"))


@query("fn_9_object_uri", "SELECT archive_id, hash, content_uri FROM ev")
def _(w):
    return w.evidence.select("archive_id", "hash", ids.object_uri(F.col("hash")).alias("content_uri"))


@query("fn_10_infer_kind", "SELECT doc_id, kind, mime_type FROM ev")
def _(w):
    kind = ids.infer_kind(F.col("path"), F.lit(None).cast("string"))
    return w.evidence.select("doc_id", kind.alias("kind"), ids.infer_mime(kind).alias("mime_type"))


@query("fn_11_iso_second", f"SELECT event_id, {iso('ts')} AS at FROM events")
def _(w):
    return w.table("events").select("event_id", ids.iso_second(F.col("ts")).alias("at"))


@query("fn_12_detect_kind", """SELECT archive_id, 'justification' AS kind, count(*) AS n FROM just GROUP BY 1 UNION ALL
 SELECT archive_id, NULL, count(*) FROM cert GROUP BY 1""")
def _(w):
    lines = writers.artifact_lines(w.justifications, "justification").unionByName(
        writers.artifact_lines(w.certificates, "certificate"))
    return lines.groupBy("archive_id", ids.detect_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


@query("fn_13_rule_arity", """SELECT s.archive_id, s.proof_id, s.inference_id, s.rule, count(*) AS inputs,
 CASE s.rule WHEN 'intuition' THEN false WHEN 'modus_ponens' THEN count(*) = 2 ELSE count(*) >= 1 END AS arity_ok,
 s.rule = 'abduction_to_best_explanation' AS weak FROM psteps s JOIN pinputs i USING (archive_id, proof_id, inference_id)
 GROUP BY 1, 2, 3, 4""")
def _(w):
    p = w.proofs
    rows = p.inputs.groupBy("archive_id", "proof_id", "inference_id").agg(F.count("*").alias("inputs")).join(
        p.steps, ["archive_id", "proof_id", "inference_id"])
    return rows.select("archive_id", "proof_id", "inference_id", "rule", "inputs",
                       proofs.rule_arity_ok(F.col("rule"), F.col("inputs")).alias("arity_ok"),
                       proofs.is_weak(F.col("rule")).alias("weak"))


@query("fn_14_row_integrity", """SELECT archive_id, tbl AS "table", tbl <> 'sources' AS hash_ok, true AS canonical_ok,
 count(*) AS n FROM rows GROUP BY 1, 2""")
def _(w):
    spoiled = w.rows.withColumn("row_hash", F.when(F.col("table") == "sources", F.reverse("row_hash"))
                                .otherwise(F.col("row_hash")))
    return verify.row_integrity(spoiled).groupBy("archive_id", "table", "hash_ok", "canonical_ok").agg(
        F.count("*").alias("n"))


@query("fn_15_blob_integrity", "SELECT archive_id, hash, hash = actual AS ok FROM pblobs")
def _(w):
    return verify.blob_integrity(w.blobs)


@query("fn_16_rationale", "SELECT DISTINCT status, rationale FROM asm")
def _(w):
    return w.assessments.select("status").distinct().withColumn("rationale", ids.rationale(F.col("status")))


@query("fn_17_key_fingerprint", "SELECT page_id, sha256(html) AS fingerprint FROM pages")
def _(w):
    body = F.base64(F.encode("html", "UTF-8"))
    pem = F.concat(F.lit("-----BEGIN PUBLIC KEY-----\n"), body, F.lit("\n-----END PUBLIC KEY-----\n"))
    return w.table("pages").select("page_id", ids.key_fingerprint(pem).alias("fingerprint"))


# --- graph ---------------------------------------------------------------------------------


@query("gr_1_build_graph", "SELECT archive_id, kind, src_kind, src_id, dst_kind, dst_id FROM edges")
def _(w):
    return graph.build_graph(w.evidence, w.sources, w.assessments)[1]


@query("gr_2_graph_integrity", """SELECT 'dangling_dst' AS issue, e.archive_id, e.kind, src_kind, src_id, dst_kind, dst_id
 FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes m WHERE m.archive_id = e.archive_id AND m.kind = e.dst_kind
 AND m.id = e.dst_id)""")
def _(w):
    return graph.graph_integrity(*w.graph)


@query("gr_3_assessments_of", "SELECT archive_id, evidence_id, assessment_id FROM asm")
def _(w):
    return graph.assessments_of(w.graph[1], w.evidence.select("archive_id", F.col("hash").alias("evidence_id")))


@query("gr_3_evidence_of", "SELECT archive_id, evidence_id, assessment_id FROM asm")
def _(w):
    return graph.evidence_of(w.graph[1], w.assessments.select("archive_id", "assessment_id"))


@query("gr_4_dependency_closure", "SELECT archive_id, root_kind, root_id, node_kind, node_id, distance FROM up")
def _(w):
    nodes, edges = w.graph
    return graph.dependency_closure(edges, nodes)


@query("gr_5_dependents_closure", f"SELECT archive_id, root_kind, root_id, node_kind, node_id, distance FROM ({_IMPACT}) i")
def _(w):
    nodes, edges = w.graph
    return graph.dependents_closure(edges, nodes)


@query("gr_6_impact", """SELECT dst_kind AS root_kind, dst_id AS root_id, src_kind AS node_kind, count(*) AS affected,
 max(distance) AS depth FROM reach GROUP BY 1, 2, 3""")
def _(w):
    nodes, edges = w.trade_graph
    out = graph.impact(nodes, edges, nodes)
    return out.groupBy("root_kind", "root_id", "node_kind").agg(
        F.count("*").alias("affected"), F.max("distance").alias("depth"))


@query("gr_6_known_roots", """SELECT archive_id, kind, id, id NOT IN ('src7', 'src19') AS exists FROM (
 SELECT DISTINCT archive_id, 'source' AS kind, source_id AS id FROM ev) x""")
def _(w):
    roots = w.evidence.select("archive_id", F.lit("source").alias("kind"), F.col("source_id").alias("id")).distinct()
    return graph.known_roots(w.graph[0], roots)


@query("gr_7_neighborhood", f"""SELECT archive_id, root_kind, root_id, node_kind, node_id, distance, 'upstream' AS direction
 FROM up UNION ALL SELECT *, 'downstream' FROM ({_IMPACT}) i""")
def _(w):
    nodes, edges = w.graph
    return graph.neighborhood(edges, nodes)


@query("gr_8_explain", f"""SELECT archive_id, 'assessment' AS kind, assessment_id AS id, 'evidence' AS relation,
 'evidence' AS node_kind, evidence_id AS node_id, 1 AS distance FROM asm UNION ALL
 SELECT archive_id, 'evidence', evidence_id, 'assessment', 'assessment', assessment_id, 1 FROM asm UNION ALL
 SELECT archive_id, root_kind, root_id, 'dependency', node_kind, node_id, distance FROM up WHERE root_kind <> 'source'
 UNION ALL SELECT archive_id, root_kind, root_id, 'dependent', node_kind, node_id, distance FROM ({_IMPACT}) i
 WHERE root_kind <> 'source'""")
def _(w):
    nodes, edges = w.graph
    return graph.explain(edges, nodes.filter("kind <> 'source'"))


def _context_sql() -> str:
    node = obj({"distance_from_anchor": n("distance"), "node_id": s("node_id"), "node_type": s("node_kind")})
    key = "archive_id, root_kind, root_id"
    down = f"""(SELECT {key}, {arr(node, "distance, node_kind, node_id")} AS nodes_json, max(distance) AS depth,
 count(*) AS total, '[' || coalesce(string_agg('"' || node_id || '"', ',' ORDER BY node_id)
 FILTER (node_kind = 'assessment'), '') || ']' AS asm_json, '[' || coalesce(string_agg('"' || node_id || '"', ','
 ORDER BY node_id) FILTER (node_kind = 'evidence'), '') || ']' AS ev_json FROM ({_IMPACT}) i GROUP BY {key})"""
    upj = f"(SELECT {key}, {arr(node, 'distance, node_kind, node_id')} AS nodes_json, count(*) AS total FROM up GROUP BY {key})"
    touch = f"""(SELECT t.archive_id, t.kind, t.id, {arr("payload", "assessment_id")} AS list_json, count(*) AS total FROM (
 SELECT a.archive_id, 'assessment' AS kind, a.assessment_id AS id, a.assessment_id FROM asm a UNION ALL
 SELECT archive_id, 'evidence', evidence_id, assessment_id FROM asm UNION ALL
 SELECT archive_id, 'source', supporting, assessment_id FROM asm WHERE supporting IS NOT NULL) t
 JOIN (SELECT archive_id, row_id, payload FROM rows WHERE tbl = 'authentication_assessments') r
 ON r.archive_id = t.archive_id AND r.row_id = t.assessment_id GROUP BY 1, 2, 3)"""
    pay = lambda t: f"(SELECT archive_id, row_id, payload FROM rows WHERE tbl = '{t}')"
    impact = obj({"affected_assessments": "coalesce(d.asm_json, '[]')", "affected_evidence": "coalesce(d.ev_json, '[]')",
                  "analysis_engine_version": q("1.0.0"), "dependency_depth_max": n("coalesce(d.depth, 0)"),
                  "root_node_id": s("a.id"), "schema_version": q("0.1.0"),
                  "total_affected_nodes": n("coalesce(d.total, 0)")})
    bundle = obj({"anchor_node_id": s("a.id"), "anchor_node_kind": s("a.kind"), "assembly_engine_version": q("1.0.0"),
                  "assembly_method_name": q("evidence_centric_v1"), "derived_assessments": "coalesce(t.list_json, '[]')",
                  "evidence": "coalesce(e.payload, 'null')",
                  "graph_neighborhood": obj({"downstream": "coalesce(d.nodes_json, '[]')",
                                             "upstream": "coalesce(u.nodes_json, '[]')"}),
                  "impact_report": impact, "provenance": "coalesce(p.payload, 'null')", "schema_version": q("0.1.0"),
                  "source": "coalesce(o.payload, 'null')",
                  "source_manifest_hash": s("sha256('am:' || a.archive_id)")})
    return f"""SELECT a.archive_id, a.kind, a.id, a.evidence_id, a.source_id, coalesce(t.total, 0) AS assessment_count,
 coalesce(u.total, 0) AS upstream_count, coalesce(d.total, 0) AS downstream_count, coalesce(d.depth, 0)
 AS dependency_depth_max, sha256('am:' || a.archive_id) AS source_manifest_hash, sha256({bundle}) AS context_bundle_hash
 FROM (SELECT archive_id, 'evidence' AS kind, hash AS id, hash AS evidence_id, source_id FROM ev UNION ALL
 SELECT archive_id, 'assessment', assessment_id, evidence_id, source_id FROM asm UNION ALL
 SELECT archive_id, 'source', id, NULL, id FROM src) a
 LEFT JOIN {down} d ON d.archive_id = a.archive_id AND d.root_kind = a.kind AND d.root_id = a.id
 LEFT JOIN {upj} u ON u.archive_id = a.archive_id AND u.root_kind = a.kind AND u.root_id = a.id
 LEFT JOIN {touch} t ON t.archive_id = a.archive_id AND t.kind = a.kind AND t.id = a.id
 LEFT JOIN {pay("evidence")} e ON e.archive_id = a.archive_id AND e.row_id = a.evidence_id
 LEFT JOIN {pay("provenance")} p ON p.archive_id = a.archive_id AND p.row_id = a.evidence_id
 LEFT JOIN {pay("sources")} o ON o.archive_id = a.archive_id AND o.row_id = a.source_id"""


@query("gr_9_context_bundle", _context_sql())
def _(w):
    nodes, edges = w.graph
    return artifacts.context_bundle(nodes, nodes, edges, w.rows, w.current_manifests)[0]


@query("gr_10_build_workspace", """SELECT archive_id, workspace_id, title, reference_count, workspace_hash FROM ws""")
def _(w):
    return artifacts.build_workspace(*w.workspace_inputs)[0].select("archive_id", "workspace_id", "title", "reference_count", "workspace_hash")


@query("gr_11_build_timeline", """SELECT archive_id, timeline_id, workspace_hash, event_count, first_timestamp,
 last_timestamp, timeline_hash FROM tl""")
def _(w):
    heads, refs = w.workspaces
    named = heads.withColumn("timeline_id", F.concat("workspace_id", F.lit(".t")))
    made = artifacts.build_timeline(named, refs, w.evidence, w.assessments)[0]
    return made.select("archive_id", "timeline_id", "workspace_hash", "event_count", "first_timestamp",
                                 "last_timestamp", "timeline_hash")


@query("gr_12_build_snapshot", f"""SELECT archive_id, workspace_id AS snapshot_id, timeline_hash, sha256({obj({
    "referenced_artifacts": "refs", "schema_version": q("1"), "snapshot_id": s("workspace_id"),
    "timeline_hash": s("timeline_hash"), "workspace_hash": s("workspace_hash")})}) AS snapshot_hash FROM tl""")
def _(w):
    heads, refs = w.workspaces
    out = artifacts.build_snapshot(heads.withColumn("snapshot_id", F.col("workspace_id")), refs, w.timelines[0])
    return out.select("archive_id", "snapshot_id", "timeline_hash", "snapshot_hash")


@query("gr_13_build_justification", """SELECT archive_id, assessment_id AS justification_id, justification_hash
 FROM just""")
def _(w):
    made = artifacts.build_justification(w.assessments, w.evidence, w.provenance, w.current_manifests)
    return made.select("archive_id", "justification_id", "justification_hash")


@query("gr_14_archive_snapshot", f"""SELECT archive_id, head AS audit_log_head_hash, total AS audit_log_total_entries,
 sha256({obj({"manifest_hash": s("sha256('am:' || archive_id)"), "audit_log_head_hash": s("head"),
              "audit_log_total_entries": n("total"), "generated_at": q("2024-01-01T00:00:00Z"),
              "schema_version": q("1")})}) AS snapshot_hash
 FROM (SELECT archive_id, arg_max(entry_hash, seq) AS head, count(*) AS total FROM ilog GROUP BY 1) x""")
def _(w):
    out = artifacts.archive_snapshot(w.current_manifests, chains.chain_head(w.ingest_log), F.timestamp_seconds(F.lit(1704067200)))
    return out.select("archive_id", "audit_log_head_hash", "audit_log_total_entries", "snapshot_hash")


@query("gr_15_verify_archive", """SELECT archive_id, 'audit_chain' AS "check", false AS ok,
 'BROKEN at seq=0: entry_hash mismatch' AS detail FROM arch UNION ALL
 SELECT archive_id, 'references', bad = 0, n || ' evidence rows, ' || bad || ' broken refs' FROM (SELECT ev.archive_id,
 count(*) AS n, count(*) FILTER (src.id IS NULL) AS bad FROM ev LEFT JOIN src ON src.archive_id = ev.archive_id
 AND src.id = ev.source_id GROUP BY 1) x UNION ALL
 SELECT archive_id, 'blobs', bad = 0, n || ' blobs rehashed, ' || bad || ' mismatch' FROM (SELECT archive_id,
 count(*) FILTER (source_id <> 'src1') AS n, count(*) FILTER (source_id IN ('src1', 'src2')) AS bad FROM ev
 GROUP BY 1) y UNION ALL SELECT archive_id, 'manifest', archive_id <> 'fr', CASE archive_id WHEN 'fr' THEN
 'stored manifest content DIVERGES from recomputed in 1 fields' ELSE 'stored content matches recomputed' END FROM arch""")
def _(w):
    # Blobs of one source are lost, those of another were overwritten; stand-in hashes break the chain.
    texts = w.table("documents").select(
        F.col("lang").alias("archive_id"), F.sha2("text", 256).alias("hash"), "doc_id",
        F.when(F.col("source") == "src2", F.lit("gone")).otherwise(F.col("text")).alias("content"))
    blobs = texts.join(w.evidence.filter("source_id <> 'src1'").select("archive_id", "doc_id"),
                       ["archive_id", "doc_id"], "left_semi")
    tables = aggregates.table_manifest(w.rows, w.archives)
    heads = aggregates.blobs_root(w.evidence, w.archives).withColumn(
        "schema_version", F.lit("0.1.0")).withColumn("notes", F.lit(None).cast("string"))
    stored = heads.withColumn("notes", F.when(F.col("archive_id") == "fr", F.lit("edited")))
    out = verify.verify_archive(w.archives, w.ingest_log, w.evidence, w.sources, blobs, stored, tables, heads, tables)
    return out.withColumn("detail", F.regexp_extract("detail", "^(BROKEN at seq=0: entry_hash mismatch|[^B].*)", 1))


def derived_state(w: World) -> dict[str, DataFrame]:
    """Headers, references and log of artifacts per workspace, with stand-in hashes and faults."""
    a, src = F.col("archive_id"), F.col("source_id")
    spaces = w.evidence.select("archive_id", "source_id").distinct()
    name = F.concat(a, F.lit("."), src)
    none = F.lit(None).cast("string")

    def heads(kind: str, declared: Column, computed: Column, ws: Column, tl: Column, man: Column) -> DataFrame:
        return spaces.select(
            "archive_id", F.lit(kind).alias("artifact_kind"), name.alias("artifact_id"),
            declared.alias("declared_hash"), computed.alias("computed_hash"), ws.alias("workspace_hash"),
            tl.alias("timeline_hash"), man.alias("source_manifest_hash"),
            F.when((src == "src0") & F.lit(kind == "snapshot"), F.lit("ValueError")).alias("decode_error"))

    h = lambda kind: sha(kind, ":", name)
    ws_link = F.when(src == "src4", sha("lost")).otherwise(h("workspace"))
    headers_ = reduce(DataFrame.unionByName, [
        heads("workspace", h("workspace"), F.when(src == "src3", sha("x")).otherwise(h("workspace")), none, none, none),
        heads("timeline", h("timeline"), h("timeline"), ws_link, h("timeline"), none),
        heads("snapshot", h("snapshot"), h("snapshot"), h("workspace"),
              F.when(src == "src5", sha("lost")).otherwise(h("timeline")), none),
        heads("justification", h("justification"), h("justification"), none, none,
              F.when(a == "fr", sha("old")).otherwise(sha("am:", a))),
        heads("attestation", h("attestation"), F.when(a == "de", sha("y")).otherwise(h("attestation")), none, none, none)])
    ref = w.evidence.select("archive_id", name.alias("artifact_id"), "hash")
    roles = [("workspace", "evidence", F.col("hash")), ("timeline", "evidence", F.col("hash")),
             ("workspace", "assessment", ids.assessment_id(F.col("hash"), F.lit("provenance_review"))),
             ("justification", "provenance_step", ids.step_id(F.col("hash"), F.lit(1).cast("long")))]
    refs = [ref.select("archive_id", F.lit(k).alias("artifact_kind"), "artifact_id", F.lit(r).alias("role"),
                       i.alias("identifier")) for k, r, i in roles]
    refs.append(spaces.select("archive_id", F.lit("justification").alias("artifact_kind"), name.alias("artifact_id"),
                              F.lit("source").alias("role"), src.alias("identifier")))
    kept = w.evidence.filter("n_chars >= 200")
    # The log knows workspaces and timelines, one timeline under an older hash, and one lost workspace per archive.
    entry = lambda kind, action, own: spaces.select(
        "archive_id", F.lit(action).alias("action"), F.concat(F.lit(f"prov:{kind}/"), name).alias("target"),
        F.create_map(F.lit("self_hash"), own).alias("parameters"), src.alias("o"))
    log = reduce(DataFrame.unionByName, [
        entry("workspace", "build_workspace", h("workspace")),
        entry("timeline", "build_timeline", F.when(src == "src6", sha("older")).otherwise(h("timeline"))),
        w.archives.select("archive_id", F.lit("build_workspace").alias("action"),
                          F.lit("prov:workspace/lost").alias("target"),
                          F.create_map(F.lit("self_hash"), sha("z")).alias("parameters"), F.lit("z").alias("o"))])
    from provlens.functions.ordered import sequenced
    log = sequenced(log, ["archive_id"], ["o", "target"]).select(
        "archive_id", F.col("position").alias("pos"), F.col("position").alias("seq"), "action", "target", "parameters")
    return {"headers": headers_, "references": reduce(DataFrame.unionByName, refs), "kept": kept, "log": log}


_SPACES = "(SELECT DISTINCT archive_id, source_id, archive_id || '.' || source_id AS name FROM ev) sp"
_RECONCILE = f"""SELECT archive_id, kind AS artifact_kind, name AS artifact_id, 'missing_audit_entry' AS issue_kind,
 'target ''' || kind || '/' || name || ''' present on disk but no audit entry references it' AS detail
 FROM {_SPACES}, (VALUES ('justification'), ('attestation'), ('snapshot')) k(kind)
 WHERE NOT (kind = 'snapshot' AND source_id = 'src0') UNION ALL
 SELECT archive_id, 'assessment', assessment_id, 'missing_audit_entry', 'target ''assessment/' || assessment_id ||
 ''' present on disk but no audit entry references it' FROM asm UNION ALL
 SELECT archive_id, 'workspace', 'lost', 'missing_persisted_artifact',
 'audit log references ''workspace/lost'' but no persisted artifact found at canonical location' FROM arch UNION ALL
 SELECT archive_id, 'timeline', name, 'audit_log_hash_mismatch', 'last entry declares self_hash ' ||
 substr(sha256('older'), 1, 8) || '... but disk has ' || substr(sha256('timeline:' || name), 1, 8) || '...'
 FROM {_SPACES} WHERE source_id = 'src6'"""
_DERIVED = f"""SELECT archive_id, 'snapshot' AS artifact_kind, name AS artifact_id, 'decode_error' AS issue_kind,
 'decode failed: ValueError' AS detail FROM {_SPACES} WHERE source_id = 'src0' UNION ALL
 SELECT archive_id, 'workspace', name, 'hash_mismatch', 'workspace_hash recompute mismatch' FROM {_SPACES}
 WHERE source_id = 'src3' UNION ALL
 SELECT archive_id, 'attestation', name, 'attestation_hash_mismatch', 'attestation_hash recompute mismatch'
 FROM {_SPACES} WHERE archive_id = 'de' UNION ALL
 SELECT archive_id, 'justification', name, 'manifest_drift', 'source_manifest_hash ' || substr(sha256('old'), 1, 8) ||
 '... != current ' || substr(sha256('am:fr'), 1, 8) || '...' FROM {_SPACES} WHERE archive_id = 'fr' UNION ALL
 SELECT archive_id, 'timeline', name, 'workspace_link_broken', 'workspace_hash ' || substr(sha256('lost'), 1, 8) ||
 '... not in <archive>/workspaces/' FROM {_SPACES} WHERE source_id = 'src4' UNION ALL
 SELECT archive_id, 'snapshot', name, 'timeline_link_broken', 'timeline_hash ' || substr(sha256('lost'), 1, 8) ||
 '... not in <archive>/timelines/' FROM {_SPACES} WHERE source_id = 'src5' UNION ALL
 SELECT archive_id, 'workspace', archive_id || '.' || source_id, 'evidence_reference_dangling', 'evidence ''' || hash ||
 ''' not found' FROM ev WHERE n_chars < 200 UNION ALL
 SELECT archive_id, 'timeline', archive_id || '.' || source_id, 'evidence_reference_dangling',
 'event references evidence ''' || hash || '''' FROM ev WHERE n_chars < 200 UNION ALL
 SELECT archive_id, 'justification', name, 'source_reference_dangling', 'chain entry references source ''' || source_id ||
 '''' FROM {_SPACES} WHERE source_id IN ('src7', 'src19') UNION ALL
 SELECT archive_id, 'justification', archive_id || '.' || source_id, 'provenance_step_dangling', 'provenance row for ' ||
 substr(hash, 1, 8) || '... not found' FROM ev WHERE n_chars < 400 UNION ALL {_RECONCILE}"""


def derived_issues(w: World) -> tuple[DataFrame, dict[str, DataFrame]]:
    d = derived_state(w)
    return verify.derived_integrity(d["headers"], d["references"], d["kept"], w.sources, w.assessments, w.provenance,
                                    w.current_manifests, d["log"]), d


@query("gr_16_derived_integrity", _DERIVED)
def _(w):
    return derived_issues(w)[0]


@query("agg_12_integrity_summary", f"""SELECT a.archive_id, i.c AS issue_count, i.c = 0 AS ok, k.c AS assessments_checked,
 s.c AS workspaces_checked, k.c + 5 * s.c AS total_checked FROM arch a
 JOIN (SELECT archive_id, count(*) AS c FROM ({_DERIVED}) d GROUP BY 1) i ON i.archive_id = a.archive_id
 JOIN (SELECT archive_id, count(*) AS c FROM asm GROUP BY 1) k ON k.archive_id = a.archive_id
 JOIN (SELECT archive_id, count(DISTINCT source_id) AS c FROM ev GROUP BY 1) s ON s.archive_id = a.archive_id""")
def _(w):
    issues, d = derived_issues(w)
    checked = d["headers"].select("archive_id", "artifact_kind").unionByName(
        w.assessments.select("archive_id", F.lit("assessment").alias("artifact_kind")))
    return aggregates.integrity_summary(issues, checked).select(
        "archive_id", "issue_count", "ok", "assessments_checked", "workspaces_checked", "total_checked")


@query("gr_17_reconcile", _RECONCILE)
def _(w):
    d = derived_state(w)
    return verify.reconcile(verify.artifact_index(d["headers"], w.assessments), d["log"])


@query("gr_18_verify_artifacts", """SELECT archive_id, kind, self_hash_ok, manifest_drift, count(*) AS n FROM (
 SELECT archive_id, 'justification' AS kind, status <> 'contradicted' AS self_hash_ok, archive_id = 'de'
 AS manifest_drift FROM asm UNION ALL SELECT archive_id, 'archive_snapshot', true, false FROM arch UNION ALL
 SELECT archive_id, NULL, NULL, false FROM cert) x GROUP BY ALL""")
def _(w):
    contradicted = w.assessments.select("archive_id", F.col("assessment_id").alias("justification_id"), "status")
    edited = w.justifications.join(contradicted, ["archive_id", "justification_id"]).withColumn(
        "justification_engine_version", F.when(F.col("status") == "contradicted", F.lit("9"))
        .otherwise(F.col("justification_engine_version")))
    snaps = artifacts.archive_snapshot(w.current_manifests, chains.chain_head(w.ingest_log),
                                       F.timestamp_seconds(F.lit(1704067200)))
    lines = reduce(DataFrame.unionByName, [
        writers.artifact_lines(edited, "justification"), writers.artifact_lines(snaps, "archive_snapshot"),
        writers.artifact_lines(w.certificates, "certificate")])
    current = w.current_manifests.withColumn("manifest_hash", F.when(
        F.col("archive_id") == "de", sha("new")).otherwise(F.col("manifest_hash")))
    out = verify.verify_artifacts(lines.select("archive_id", F.lit("").alias("artifact_name"),
                                               F.col("value").alias("text")), current)
    return out.groupBy("archive_id", "kind", "self_hash_ok", "manifest_drift").agg(F.count("*").alias("n"))


# --- proofs and media ----------------------------------------------------------------------


@query("gr_19_proof_errors", """SELECT archive_id, proof_id, subject, error FROM perrors WHERE error IS NOT NULL""")
def _(w):
    return proofs.proof_errors(w.proofs)


_CYCLIC = """SELECT DISTINCT archive_id, proof_id, target AS claim_id FROM preach r WHERE EXISTS (SELECT 1 FROM preach c
 WHERE c.archive_id = r.archive_id AND c.proof_id = r.proof_id AND c.origin = r.target AND c.target = c.origin)"""


@query("gr_20_proof_cycles", _CYCLIC)
def _(w):
    return proofs.proof_cycles(w.proofs)


@query("gr_21_proof_verdicts", f"""SELECT h.archive_id, h.proof_id, coalesce(e.c, 0) AS error_count,
 y.proof_id IS NOT NULL AS cyclic, CASE WHEN e.c IS NULL AND y.proof_id IS NULL THEN true END AS conclusion_reached,
 e.c IS NULL AND y.proof_id IS NULL AS ok FROM (SELECT DISTINCT archive_id, proof_id FROM turns) h
 LEFT JOIN (SELECT archive_id, proof_id, count(*) AS c FROM perrors WHERE error IS NOT NULL GROUP BY 1, 2) e
 ON e.archive_id = h.archive_id AND e.proof_id = h.proof_id
 LEFT JOIN (SELECT DISTINCT archive_id, proof_id FROM ({_CYCLIC}) z) y ON y.archive_id = h.archive_id
 AND y.proof_id = h.proof_id""")
def _(w):
    return proofs.proof_verdicts(w.proofs)


@query("gr_22_media_chain_status", """SELECT 'orders' AS archive_id, sha256(cast(o_orderkey AS varchar)) AS evidence_sha256,
 reason IS NULL AS chain_verified, reason AS failure_reason FROM (SELECT o_orderkey, CASE
 WHEN min(l_linenumber) > 1 THEN 'expected one root, found 0' WHEN roots <> 1 THEN 'expected one root, found ' || roots
 WHEN copies > 1 THEN 'duplicate labels' WHEN orphans > 0 THEN 'unknown parent' WHEN unsigned > 0
 THEN 'signature did not verify' WHEN status = 'F' THEN 'leaf hash differs' END AS reason FROM (SELECT o_orderkey,
 l_linenumber, o_orderstatus AS status, count(*) FILTER (l_linenumber = 1) OVER k AS roots,
 max(c) OVER k AS copies, count(*) FILTER (l_linenumber > 1 AND NOT has_parent) OVER k AS orphans,
 count(*) FILTER (l_returnflag = 'R') OVER k AS unsigned FROM (SELECT o_orderkey, o_orderstatus, l_linenumber, l_returnflag,
 count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c, EXISTS (SELECT 1 FROM lineitem p WHERE
 p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber - 1) AS has_parent FROM lineitem l JOIN orders
 ON o_orderkey = l_orderkey) x WINDOW k AS (PARTITION BY o_orderkey)) y
 GROUP BY o_orderkey, roots, copies, orphans, unsigned, status) z""")
def _(w):
    # A chain of manifests per order: each line builds on the line before it.
    line = F.col("l_linenumber")
    rows = w.table("lineitem").join(w.table("orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    digest = sha(F.col("l_orderkey").cast("string"))
    manifests = rows.select(
        F.lit("orders").alias("archive_id"), digest.alias("evidence_sha256"), line.cast("string").alias("label"),
        F.when(line > 1, (line - 1).cast("string")).alias("parent_label"),
        (F.col("l_returnflag") != "R").alias("signature_verified"),
        F.when(F.col("o_orderstatus") == "F", sha("other")).otherwise(digest).alias("declared_sha256"))
    return media.media_chain_status(manifests)


@query("gr_23_certificate_window", """SELECT 'orders' AS archive_id, l_orderkey AS chain_id, coalesce(fault,
 CASE WHEN NOT anchored THEN 'root certificate is not in the trust list' END) IS NULL AS verified, coalesce(fault,
 CASE WHEN NOT anchored THEN 'root certificate is not in the trust list' END) AS reason FROM (SELECT l_orderkey,
 arg_min(f, CASE WHEN f IS NOT NULL THEN i_pos END) AS fault, arg_max(a, i_pos) AS anchored FROM (SELECT l_orderkey, i_pos,
 CASE WHEN TIMESTAMP '1997-06-01' < l_shipdate THEN 'cert[' || i_pos || '] is not yet valid'
 WHEN TIMESTAMP '1997-06-01' > l_shipdate + INTERVAL 1200 DAY THEN 'cert[' || i_pos || '] has expired' END AS f,
 s_suppkey IS NOT NULL AS a FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
 l_suppkey, l_shipdate, l_extendedprice) - 1 AS i_pos FROM lineitem) l LEFT JOIN (SELECT s_suppkey FROM supplier
 WHERE s_acctbal >= 0) s ON s_suppkey = l_suppkey) x GROUP BY 1) y""")
def _(w):
    from provlens.functions.ordered import sequenced
    rows = sequenced(w.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                                "l_extendedprice"),
                     ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])
    certs = rows.select(F.lit("orders").alias("archive_id"), F.col("l_orderkey").alias("chain_id"), "position",
                        F.col("l_suppkey").alias("certificate_id"), F.col("l_shipdate").alias("not_before"),
                        (F.col("l_shipdate") + F.expr("INTERVAL 1200 DAYS")).alias("not_after"))
    anchors = w.table("supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("certificate_id"))
    moment = F.to_timestamp(F.lit("1997-06-01 00:00:00"))
    return media.certificate_window(certs, anchors, moment)


_BATCH = """SELECT *, CASE WHEN source_id = 'src7' THEN 'source_unknown' WHEN source_id = 'src2' AND source_path LIKE '%.png'
 THEN 'source_contradicted' END AS reason FROM (SELECT docs.*, path AS source_path FROM docs) d"""
_ACCEPTED = f"""SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY archive_id, hash ORDER BY doc_id) AS rn
 FROM ({_BATCH}) b WHERE reason IS NULL) x WHERE rn = 1"""


def batch(w: World) -> DataFrame:
    """All documents as files to ingest; one source is unnamed, one is renamed by images."""
    src, image = F.col("source_id"), F.col("path").endswith(".png")
    return w.documents.select(
        "archive_id", F.col("doc_id").alias("arrival"), "path", "hash", "size_bytes", "source_id",
        F.concat(F.lit("op-"), src).alias("ingested_by"), "ingested_at",
        F.when(src != "src7", F.when((src == "src2") & image, F.lit("Another")).otherwise(
            F.concat(F.lit("Source "), src))).alias("source_name"),
        F.lit("news_outlet").alias("source_kind"), F.lit("primary").alias("source_authority"))


def ingested(w: World) -> ingesting.Ingested:
    stored = w.sources.filter("id = 'src2'")
    nothing = w.evidence.filter(F.lit(False))
    return ingesting.ingest(batch(w), nothing, stored)


@query("gr_24_ingest_evidence", f"SELECT archive_id, hash, source_id, size_bytes, 'op-' || source_id AS ingested_by FROM ({_ACCEPTED}) a")
def _(w):
    return ingested(w).evidence.select("archive_id", "hash", "source_id", "size_bytes", "ingested_by")


@query("gr_24_ingest_rejected", f"""SELECT b.archive_id, b.doc_id AS arrival, b.hash, b.reason FROM ({_BATCH}) b
 LEFT JOIN ({_ACCEPTED}) a ON a.archive_id = b.archive_id AND a.hash = b.hash
 WHERE b.reason IS NOT NULL AND (a.doc_id IS NULL OR a.doc_id > b.doc_id)""")
def _(w):
    return ingested(w).rejected.select("archive_id", "arrival", "hash", "reason")


@query("gr_24_ingest_audit", f"""SELECT archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY doc_id) AS seq,
 'prov:evidence/sha256:' || hash AS target, cast(size_bytes AS varchar) AS size_bytes FROM ({_ACCEPTED}) a UNION ALL
 SELECT archive_id, 0, 'prov:archive/bootstrap', NULL FROM arch""")
def _(w):
    return ingested(w).audit.select("archive_id", "seq", "target",
                                    F.try_element_at("parameters", F.lit("size_bytes")).alias("size_bytes"))


@query("gr_25_record_derived", """SELECT archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY assessment_id) - 1
 AS seq, 'assess_authentication' AS action, 'prov:assessment/' || assessment_id AS target, evidence_id AS self_hash FROM asm""")
def _(w):
    rows = w.assessments.select("archive_id", F.lit("assess_authentication").alias("action"),
                                F.col("assessment_id").alias("artifact_id"), F.col("evidence_id").alias("self_hash"),
                                F.lit("op").alias("actor"), F.col("created_at").alias("recorded_at"))
    return ingesting.record_derived(None, rows, ["artifact_id"]).select(
        "archive_id", "seq", "action", "target", F.element_at("parameters", "self_hash").alias("self_hash"))


@query("gr_26_trust_timeline", """SELECT p.archive_id, p.hash, 'capture' AS kind, c.captured_at AS timestamp,
 c.certificate_hash AS event_hash, 1 AS count FROM prov p JOIN cert c ON c.archive_id = p.archive_id AND c.hash = p.hash
 WHERE p.n_steps > 0 UNION ALL SELECT archive_id, hash, 'ingest', timestamp, entry_hash, 1 FROM ilog UNION ALL
 SELECT i.archive_id, i.hash, 'manifest', min(m.signed_at), arg_min(m.manifest_hash, m.sequence), count(*) FROM ilog i
 JOIN man m ON m.archive_id = i.archive_id AND m.audit_entry_count > i.seq GROUP BY 1, 2 UNION ALL
 SELECT archive_id, hash, 'proof', NULL, sha256('proof:' || proof_id), 1 FROM cref""")
def _(w):
    return trust(w)


@query("gr_27_proof_levels", """SELECT archive_id, proof_id, 'c' || turn AS claim_id, turn AS level FROM turns
 WHERE last_role <> 'user' OR last = 0 OR turn = 0""")
def _(w):
    return proofs.proof_levels(w.proofs)


# --- streams -------------------------------------------------------------------------------


@query("str_1_stream_ingest", "SELECT DISTINCT archive_id, hash FROM docs")
def _(w):
    # Documents arrive as a stream of files; each content is kept once per archive.
    landing, table, log = (scratch(w.spark, n) for n in ("arrivals", "held", "progress"))
    w.documents.select("archive_id", "hash", F.col("ingested_at").alias("arrived_at")).write.parquet(landing)
    stream = w.spark.readStream.schema("archive_id string, hash string, arrived_at timestamp").parquet(landing)
    run = (streams.stream_ingest(stream).writeStream.foreachBatch(streams.upsert_new(table))
           .option("checkpointLocation", log).trigger(availableNow=True).start())
    run.awaitTermination()
    return w.spark.read.parquet(table).select("archive_id", "hash")


@query("str_2_stream_verify_chain", f"""SELECT archive_id, pos, seq, reason FROM (SELECT *, {_REASON} AS reason
 FROM tlink) x WHERE reason IS NOT NULL""")
def _(w):
    # Entries come in no order, a file at a time; each part of a log waits for what is missing.
    landing, failures, log = (scratch(w.spark, n) for n in ("entries", "failures", "progress"))
    w.tampered_log.repartition(4).write.parquet(landing)
    stream = w.spark.readStream.schema(w.tampered_log.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    with chain_state.keyed_state_store(w.spark):
        run = (chain_state.stream_verify_chain(stream).writeStream.format("parquet").option("path", failures)
               .option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start())
        run.awaitTermination()
    return w.spark.read.schema("archive_id string, pos long, seq long, reason string").parquet(failures)


@query("str_3_stream_action_counts", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS window_start,
 event_type AS action, count(*) AS count FROM events GROUP BY ALL""")
def _(w):
    # Four files in order of time, a batch each; windows that are over leave the state.
    landing, table, log = (scratch(w.spark, n) for n in ("entries", "counts", "progress"))
    entries = w.events.select(F.col("ts").cast("timestamp").alias("timestamp"), "action")
    low, high = entries.select(F.min(F.col("timestamp").cast("long")), F.max(F.col("timestamp").cast("long"))).first()
    part = F.least(F.floor((F.col("timestamp").cast("long") - low) * 4 / max(1, high - low)), F.lit(3))
    for i in range(4):
        entries.filter(part == i).coalesce(1).write.mode("append").parquet(landing)
    stream = w.spark.readStream.schema("timestamp timestamp, action string").option("maxFilesPerTrigger", 1).parquet(landing)
    run = (streams.stream_action_counts(stream).writeStream.foreachBatch(streams.merge_counts(table))
           .outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).start())
    run.awaitTermination()
    return streams.merged_counts(w.spark, table).select(text("window_start").alias("window_start"), "action", "count")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(World(spark, folder))

    return {name: run(fn) for name, fn in QUERIES.items()}
