"""Batch ingestion and recording of derived artifacts in the audit log."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens import schemas
from provlens.functions import identifiers as ids
from provlens.operators import chains, joins
from provlens.session import stable

# The gap declared by a fresh custody record, without and with a
# capture certificate.
PLAIN_GAP = "ingestión inicial sin reconstrucción de cadena previa al artefacto"
CAPTURED_GAP = "intervalo entre captura firmada y ingestión sin reconstrucción"

_OPTIONAL = ("kind", "mime_type", "source_name", "source_kind", "source_authority",
             "source_jurisdiction", "source_license", "notes", "certificate_hash")


class Ingested(NamedTuple):
    evidence: DataFrame
    sources: DataFrame
    provenance: DataFrame
    provenance_steps: DataFrame
    audit: DataFrame
    rejected: DataFrame


def _map(pairs: dict[str, Column]) -> Column:
    """A string map that leaves out null and empty values."""
    entries = F.array_compact(F.array(*[
        F.when(F.length(v) > 0, F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in pairs.items()]))
    return F.map_from_entries(entries)


_SOURCE_FIELDS = ("name", "kind", "authority", "jurisdiction", "license")


def _settled_sources(rows: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources that a batch creates (with ``arrival``), and per row the reason its source refuses it.

    Which row creates a source depends on what was accepted before, and that on other sources.
    Sources are settled in rounds: the first complete row of an open source creates it unless
    its content was accepted earlier, or still may be. The earliest such row of all is always
    free, so every round settles a source; mostly one settles all.
    """
    mention = stable(rows.select(
        "archive_id", "arrival", "hash", F.col("source_id").alias("id"), F.col("source_kind").alias("kind"),
        F.col("source_name").alias("name"), F.col("source_authority").alias("authority"),
        F.col("source_jurisdiction").alias("jurisdiction"), F.col("source_license").alias("license")))
    key = ["archive_id", "id"]
    stored = sources.select(*key, *_SOURCE_FIELDS)
    settled = stable(stored.withColumn("since", F.lit(None).cast("long")))
    complete = mention.filter("name IS NOT NULL AND kind IS NOT NULL AND authority IS NOT NULL")
    open_ids = stable(complete.select(*key).distinct().join(stored, key, "left_anti"))

    def judged(settled: DataFrame) -> DataFrame:
        old = settled.select(*key, "since", F.struct(*_SOURCE_FIELDS).alias("old"))
        clash = reduce(or_, [F.coalesce(F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"old.{f}")), F.lit(False))
                             for f in _SOURCE_FIELDS])
        reason = (F.when(F.col("old").isNull() | (F.col("since") > F.col("arrival")), F.lit("source_unknown"))
                  .when(clash, F.lit("source_contradicted")))
        return mention.join(old, key, "left").select("archive_id", "arrival", "hash", reason.alias("reason"))

    while not open_ids.isEmpty():
        accepted = judged(settled).filter("reason IS NULL").groupBy("archive_id", "hash").agg(F.min("arrival").alias("known"))
        waiting = complete.join(open_ids, key, "left_semi").join(accepted, ["archive_id", "hash"], "left").filter(
            "known IS NULL OR known > arrival").drop("known")
        first = stable(chains.dedupe_first(waiting, key, ["arrival"]))
        # Rows of open sources from their candidate on may yet be accepted.
        maybe = (mention.join(first.select(*key, F.col("arrival").alias("from")), key).filter("arrival >= from")
                 .groupBy("archive_id", "hash").agg(F.min("arrival").alias("maybe")))
        free = stable(first.join(maybe, ["archive_id", "hash"], "left").filter("maybe IS NULL OR maybe >= arrival")
                      .select(*key, *_SOURCE_FIELDS, F.col("arrival").cast("long").alias("since")))
        settled = stable(settled.unionByName(free))
        open_ids = stable(open_ids.join(first, key, "left_semi").join(free, key, "left_anti"))
    made = settled.filter("since IS NOT NULL").withColumnRenamed("since", "arrival")
    return made, judged(settled).select("archive_id", "arrival", "reason")


def ingest(batch: DataFrame, evidence: DataFrame, sources: DataFrame, log: DataFrame | None = None,
           certificates: DataFrame | None = None, namespace: str = schemas.NAMESPACE) -> Ingested:
    """New rows for every table from a batch of hashed files.

    ``batch``: ``archive_id, arrival, path, hash, size_bytes, source_id,
    ingested_by, ingested_at`` and any of the optional columns; ``arrival`` is unique in
    an archive. Rows are judged as if they came one by one: a certificate that is
    missing, altered or made for another blob refuses its row, even of known content;
    known content, stored or accepted earlier in the batch, is left alone; else a source
    not stored yet is created by a row that brings name, kind and authority, and a row
    that contradicts its source, or comes before there is one, is rejected.
    """
    for c in _OPTIONAL:
        if c not in batch.columns:
            batch = batch.withColumn(c, F.lit(None).cast("string"))
    rows = (batch.withColumn("kind", F.coalesce("kind", ids.infer_kind(F.col("path"), F.col("mime_type"))))
            .withColumn("mime_type", F.coalesce("mime_type", ids.infer_mime(F.col("kind")))))
    if certificates is not None:
        held = joins.certificate_binding(rows.filter("certificate_hash IS NOT NULL"), certificates)
        rows = rows.join(held.distinct(), ["archive_id", "hash", "certificate_hash"], "left")
        facts = certificates.select(
            "archive_id", "certificate_hash", F.struct("operator_id", "captured_at", "device_id", "location",
                                                       "notes", "public_key_fingerprint",
                                                       "signature_algorithm").alias("certificate"))
    else:
        rows = rows.withColumn("binding", F.lit(None).cast("string"))
        facts = None
    refused = F.coalesce(F.col("binding") != "bound", F.lit(False))
    rows = stable(rows)
    bad = rows.filter(refused).withColumn("reason", F.concat(F.lit("certificate_"), F.col("binding")))
    rows = rows.filter(~refused).join(evidence.select("archive_id", "hash"), ["archive_id", "hash"], "left_anti")
    created, verdict = _settled_sources(rows, sources)
    rows = rows.join(verdict, ["archive_id", "arrival"])
    first = rows.filter("reason IS NULL").groupBy("archive_id", "hash").agg(F.min("arrival").alias("_accepted"))
    # Rows after the one that brought the content change nothing, whatever their source says.
    rows = (rows.join(first, ["archive_id", "hash"], "left").filter("_accepted IS NULL OR arrival <= _accepted")
            .drop("_accepted").unionByName(bad).drop("binding"))

    rejected = rows.filter("reason IS NOT NULL").select("archive_id", "arrival", "path", "hash", "reason")
    accepted = chains.dedupe_first(rows.filter("reason IS NULL").drop("reason"), ["archive_id", "hash"], ["arrival"])
    accepted = (accepted.join(facts, ["archive_id", "certificate_hash"], "left") if facts is not None
                else accepted.withColumn("certificate", F.lit(None).cast(
                    "struct<operator_id:string,captured_at:string,device_id:string,location:string,"
                    "notes:string,public_key_fingerprint:string,signature_algorithm:string>")))

    new_evidence = accepted.select(
        "archive_id", "hash", "kind", ids.object_uri(F.col("hash")).alias("content_uri"), "size_bytes",
        "mime_type", "source_id", F.lit("active").alias("status"), "ingested_at", "ingested_by",
        F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), "notes")
    captured = F.col("certificate").isNotNull()
    step = F.struct(
        F.lit(1).cast("long").alias("step_id"), F.lit("original_capture").alias("kind"),
        F.col("certificate.operator_id").alias("actor"), F.col("certificate.captured_at").alias("timestamp"),
        F.array().cast(schemas.STRINGS).alias("inputs"), F.array().cast(schemas.STRINGS).alias("outputs"),
        F.when(captured, _map({
            "capture_certificate_hash": F.col("certificate_hash"),
            "public_key_fingerprint": F.col("certificate.public_key_fingerprint"),
            "signature_algorithm": F.col("certificate.signature_algorithm"),
            "device_id": F.col("certificate.device_id"),
            "location": F.col("certificate.location")}))
        .otherwise(F.create_map().cast(schemas.STRING_MAP)).alias("parameters"),
        F.col("certificate.notes").alias("notes"))
    gap = F.when(captured, F.lit(CAPTURED_GAP)).otherwise(F.lit(PLAIN_GAP))
    provenance = accepted.select(
        "archive_id", F.col("hash").alias("evidence_hash"), F.col("source_id").alias("origin_source_id"),
        F.array(step).alias("steps"), F.lit(False).alias("is_complete"),
        F.array(F.struct(gap.alias("description"))).alias("gaps"),
        F.col("ingested_by").alias("attestor"), F.col("ingested_at").alias("attested_at"))
    steps = provenance.select("archive_id", "evidence_hash", F.explode("steps").alias("s")).select(
        "archive_id", ids.step_id(F.col("evidence_hash"), F.col("s.step_id")).alias("row_id"), "s.*")

    entries = accepted.select(
        "archive_id", F.col("arrival").cast("long").alias("arrival"), F.lit(1).alias("rank"),
        ids.iso_second(F.col("ingested_at")).alias("timestamp"), F.col("ingested_by").alias("actor"),
        F.lit("ingest_evidence").alias("action"), ids.evidence_uri(F.col("hash"), namespace).alias("target"),
        _map({"size_bytes": F.col("size_bytes").cast("string"),
              "capture_certificate_hash": F.when(captured, F.col("certificate_hash"))}).alias("parameters"),
        F.lit("success").alias("result"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version"))
    opened = rows if log is None else rows.join(log.select("archive_id").distinct(), "archive_id", "left_anti")
    opening = opened.groupBy("archive_id").agg(
        F.min_by(F.struct("ingested_by", "ingested_at"), "arrival").alias("f")).select(
        "archive_id", F.lit(-1).cast("long").alias("arrival"), F.lit(0).alias("rank"),
        ids.iso_second(F.col("f.ingested_at")).alias("timestamp"), F.col("f.ingested_by").alias("actor"),
        F.lit("archive_bootstrap").alias("action"), F.lit(f"{namespace}:archive/bootstrap").alias("target"),
        F.create_map().cast(schemas.STRING_MAP).alias("parameters"), F.lit("success").alias("result"),
        F.lit(schemas.SCHEMA_VERSION).alias("schema_version"))
    audit = chains.append_chain(log, opening.unionByName(entries), ["rank", "arrival"])
    used = accepted.select("archive_id", F.col("source_id").alias("id")).distinct()
    return Ingested(new_evidence, created.drop("arrival").join(used, ["archive_id", "id"], "left_semi"),
                    provenance, steps, audit, rejected)


def record_derived(log: DataFrame | None, artifacts: DataFrame, order: list[str],
                   namespace: str = schemas.NAMESPACE) -> DataFrame:
    """Audit entries for persisted artifacts.

    ``artifacts``: ``archive_id, action, artifact_id, self_hash, actor,
    recorded_at``. Only the six derived actions are recorded.
    """
    kinds = F.create_map(*[F.lit(x) for kv in schemas.DERIVED_ACTIONS.items() for x in kv])
    entries = artifacts.filter(F.col("action").isin(list(schemas.DERIVED_ACTIONS))).select(
        "archive_id", *[c for c in order if c != "archive_id"],
        ids.iso_second(F.col("recorded_at")).alias("timestamp"),
        *([] if "actor" in order else ["actor"]), *([] if "action" in order else ["action"]),
        F.concat(F.lit(f"{namespace}:"), F.element_at(kinds, F.col("action")), F.lit("/"),
                 F.col("artifact_id")).alias("target"),
        F.create_map(F.lit("self_hash"), F.col("self_hash")).alias("parameters"),
        F.lit("success").alias("result"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version"))
    return chains.append_chain(log, entries, order)


