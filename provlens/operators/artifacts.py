"""Builders of derived artifacts.

Lists that grow with the archive (workspace references, timeline events, context
neighborhoods) stay in long form and only their digest enters the header row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens import schemas
from provlens.functions import canonical as canon
from provlens.functions import identifiers as ids
from provlens.functions.documents import items, record_digest
from provlens.operators import graph
from provlens.operators.aggregates import timeline_bounds

_SEP = "\x00"


def _text(name: str) -> Column:
    return F.coalesce(canon.json_text(F.col(name)), F.lit("null"))


def _version() -> Column:
    return F.lit(f'"{schemas.ARTIFACT_SCHEMA_VERSION}"')


def _reference_items(references: DataFrame, keys: list[str]) -> DataFrame:
    columns = ["reference_type", "identifier", "artifact_hash"]
    return items(references, keys, F.concat_ws(_SEP, *columns),
                 canon.canonical_struct({c: (F.col(c), schemas.S) for c in columns}))


def build_workspace(headers: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header rows with ``workspace_hash`` and the hashed references.

    ``headers``: ``archive_id, workspace_id, title, source_manifest_hash``;
    ``references``: ``archive_id, workspace_id, reference_type, identifier``. A
    workspace with a repeated reference or an unknown type is refused.
    """
    keys = ["archive_id", "workspace_id"]
    counted = references.groupBy(*keys, "reference_type", "identifier").agg(F.count("*").alias("n"))
    totals = counted.groupBy(*keys).agg(
        F.count("*").alias("reference_count"),
        F.max((F.col("n") > 1) | ~F.col("reference_type").isin(schemas.REFERENCE_TYPES)).alias("refused"))
    kept = (headers.join(totals, keys, "left").filter(~F.coalesce("refused", F.lit(False)))
            .withColumn("reference_count", F.coalesce("reference_count", F.lit(0))).drop("refused"))
    hashed = counted.join(kept.select(*keys), keys, "left_semi").select(
        *keys, "reference_type", "identifier",
        ids.ref_hash(F.col("reference_type"), F.col("identifier")).alias("artifact_hash"))
    built = record_digest(kept, keys, {
        "references": _reference_items(hashed, keys),
        "schema_version": _version(),
        "source_manifest_hash": _text("source_manifest_hash"),
        "title": _text("title"),
        "workspace_id": _text("workspace_id")}, "workspace_hash")
    return built, hashed


def timeline_events(references: DataFrame, evidence: DataFrame, assessments: DataFrame) -> DataFrame:
    """Events of references with a time of their own; unresolved ones drop out."""
    keys = [c for c in references.columns if c not in ("reference_type", "identifier", "artifact_hash")]
    ev = references.filter(F.col("reference_type") == "evidence").join(
        evidence.select("archive_id", F.col("hash").alias("identifier"),
                        F.col("ingested_at").alias("observed_at")), ["archive_id", "identifier"])
    asm = references.filter(F.col("reference_type") == "assessment").join(
        assessments.select("archive_id", F.col("assessment_id").alias("identifier"),
                           F.col("created_at").alias("observed_at")), ["archive_id", "identifier"])

    def event(df: DataFrame, kind: str, own_hash: Column, origin: str) -> DataFrame:
        return df.select(*keys, F.lit(kind).alias("artifact_type"),
                         F.col("identifier").alias("artifact_identifier"), own_hash.alias("artifact_hash"),
                         "observed_at", F.lit(origin).alias("source_reference"))

    return event(ev, "evidence", F.col("identifier"), "evidence.ingested_at").unionByName(
        event(asm, "assessment", F.sha2("identifier", 256), "assessment.created_at"))


def build_timeline(workspaces: DataFrame, references: DataFrame, evidence: DataFrame,
                   assessments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header rows with ``timeline_hash`` and the events.

    ``workspaces`` has ``archive_id, workspace_id, workspace_hash, timeline_id``.
    """
    keys = ["archive_id", "timeline_id"]
    refs = references.join(workspaces.select("archive_id", "workspace_id", "timeline_id"),
                           ["archive_id", "workspace_id"]).drop("workspace_id")
    events = timeline_events(refs, evidence, assessments).withColumn(
        "observed_at", ids.iso_second(F.col("observed_at")))
    headers = (workspaces.select(*keys, "workspace_hash")
               .join(timeline_bounds(events, keys), keys, "left")
               .withColumn("event_count", F.coalesce("event_count", F.lit(0))))
    order = F.concat_ws(_SEP, "observed_at", "artifact_hash", "artifact_type", "artifact_identifier",
                        "source_reference")
    text = canon.canonical_struct({f.name: (F.col(f.name), f.dataType) for f in schemas.EVENT.fields})
    built = record_digest(headers, keys, {
        "event_count": F.col("event_count").cast("string"),
        "first_timestamp": _text("first_timestamp"),
        "last_timestamp": _text("last_timestamp"),
        "ordered_events": items(events, keys, order, text),
        "schema_version": _version(),
        "timeline_id": _text("timeline_id"),
        "workspace_hash": _text("workspace_hash")}, "timeline_hash")
    return built, events


def build_snapshot(workspaces: DataFrame, references: DataFrame, timelines: DataFrame) -> DataFrame:
    """One snapshot per workspace and timeline; ``workspaces`` brings ``snapshot_id``."""
    keys = ["archive_id", "snapshot_id"]
    headers = (workspaces.select(*keys, "workspace_id", "workspace_hash")
               .join(timelines.select("archive_id", "workspace_hash", "timeline_hash"),
                     ["archive_id", "workspace_hash"]))
    refs = references.join(headers.select(*keys, "workspace_id"), ["archive_id", "workspace_id"])
    return record_digest(headers, keys, {
        "referenced_artifacts": _reference_items(refs, keys),
        "schema_version": _version(),
        "snapshot_id": _text("snapshot_id"),
        "timeline_hash": _text("timeline_hash"),
        "workspace_hash": _text("workspace_hash")}, "snapshot_hash")


def build_justification(assessments: DataFrame, evidence: DataFrame, provenance: DataFrame,
                        manifests: DataFrame, justification_id: Column | None = None,
                        workspaces: DataFrame | None = None) -> DataFrame:
    """The deductive chain behind each assessment, as one landed-form row.

    The lists hang on one evidence, its custody steps and the cited sources, so
    they are built in place; the graph below an assessment is two levels deep.
    ``workspaces`` may give a ``workspace_hash`` per ``assessment_id``.
    """
    ev = evidence.select("archive_id", F.col("hash").alias("evidence_id"), F.col("source_id").alias("origin"))
    prov = provenance.select("archive_id", F.col("evidence_hash").alias("evidence_id"), "steps")
    rows = (assessments.select("archive_id", "assessment_id", "evidence_id", "supporting_source_ids")
            .join(ev, ["archive_id", "evidence_id"], "left")
            .join(prov, ["archive_id", "evidence_id"], "left")
            .join(manifests.select("archive_id", F.col("manifest_hash").alias("source_manifest_hash")),
                  "archive_id"))
    if workspaces is not None:
        rows = rows.join(workspaces.select("archive_id", "assessment_id", "workspace_hash"),
                         ["archive_id", "assessment_id"], "left")
    else:
        rows = rows.withColumn("workspace_hash", F.lit(None).cast("string"))

    def entries(role: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(
            F.lit(role).alias("entry_role"), n.alias("entry_identifier"),
            ids.ref_hash(F.lit(role), n).alias("entry_hash")))

    def ordered(array: Column) -> Column:
        return F.array_sort(F.array_distinct(array))

    none = F.array().cast(schemas.STRINGS)
    known = F.col("origin").isNotNull()
    sources = F.col("supporting_source_ids")
    steps = F.when(known, F.transform("steps", lambda s: ids.step_id(F.col("evidence_id"), s["step_id"])))
    below = F.concat(
        F.array(F.concat(F.lit("evidence:"), F.col("evidence_id"))),
        F.when(known, F.array(F.concat(F.lit("source:"), F.col("origin")))).otherwise(none),
        F.transform(sources, lambda s: F.concat(F.lit("source:"), s)))
    built = rows.select(
        "archive_id",
        (F.col("assessment_id") if justification_id is None else justification_id).alias("justification_id"),
        F.lit("assessment").alias("conclusion_anchor_type"),
        F.col("assessment_id").alias("conclusion_anchor_id"),
        ids.ref_hash(F.lit("assessment"), F.col("assessment_id")).alias("conclusion_anchor_hash"),
        ordered(F.concat(entries("evidence", F.when(known, F.array("evidence_id")).otherwise(none)),
                         entries("source", sources))).alias("minimal_evidence"),
        entries("assessment", F.array("assessment_id")).alias("supporting_assessments"),
        ordered(entries("graph_node", below)).alias("graph_nodes_used"),
        F.array().cast(f"array<{schemas.ENTRY.simpleString()}>").alias("intermediate_artifacts"),
        ordered(entries("provenance_step", F.coalesce(steps, none))).alias("provenance_chain"),
        "workspace_hash", "source_manifest_hash",
        F.lit(schemas.ENGINE_VERSION).alias("justification_engine_version"),
        F.lit(schemas.JUSTIFICATION_METHOD).alias("justification_method_name"),
        F.lit(schemas.ARTIFACT_SCHEMA_VERSION).alias("schema_version"))
    return built.withColumn("justification_hash", canon.self_hash(built, "justification"))


def archive_snapshot(manifests: DataFrame, heads: DataFrame, generated_at: Column) -> DataFrame:
    rows = (manifests.select("archive_id", "manifest_hash")
            .join(heads.select("archive_id", F.col("head_hash").alias("audit_log_head_hash"),
                               F.col("total").alias("audit_log_total_entries")), "archive_id")
            .withColumn("generated_at", ids.iso_second(generated_at))
            .withColumn("schema_version", F.lit(schemas.ARTIFACT_SCHEMA_VERSION)))
    return rows.withColumn("snapshot_hash", canon.self_hash(rows, "archive_snapshot"))


def context_bundle(anchors: DataFrame, nodes: DataFrame, edges: DataFrame, payloads: DataFrame,
                   manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bundle headers (counts, manifest hash, own hash) and the neighborhood rows.

    ``anchors``: ``archive_id, kind, id``; ``payloads``: ``archive_id, table,
    row_id, payload`` with the canonical row text.
    """
    key = ["archive_id", "kind", "id"]
    known = anchors.join(nodes, key, "left_semi").distinct()
    around = graph.neighborhood(edges, known).select(
        "archive_id", F.col("root_kind").alias("kind"), F.col("root_id").alias("id"), "direction",
        "node_kind", "node_id", "distance")

    def targets(kind: str, name: str) -> DataFrame:
        return edges.filter(F.col("kind") == kind).select(
            "archive_id", F.col("src_id").alias("from_id"), F.col("dst_id").alias(name))

    def texts(table: str, name: str, id_col: str) -> DataFrame:
        return payloads.filter(F.col("table") == table).select(
            "archive_id", F.col("row_id").alias(id_col), F.col("payload").alias(name))

    is_source = F.col("kind") == "source"
    via = targets("assessed_from", "assessed_id").withColumnRenamed("from_id", "id").withColumn(
        "kind", F.lit("assessment"))
    heads = known.join(via, key, "left").withColumn(
        "evidence_id", F.when(F.col("kind") == "evidence", F.col("id")).otherwise(F.col("assessed_id")))
    origin = targets("sourced_from", "origin_id").withColumnRenamed("from_id", "evidence_id")
    heads = (heads.join(origin, ["archive_id", "evidence_id"], "left")
             .withColumn("source_id", F.when(is_source, F.col("id")).otherwise(F.col("origin_id")))
             .join(texts("evidence", "evidence", "evidence_id"), ["archive_id", "evidence_id"], "left")
             .join(texts("provenance", "provenance", "evidence_id"), ["archive_id", "evidence_id"], "left")
             .join(texts("sources", "source", "source_id"), ["archive_id", "source_id"], "left")
             .join(manifests.select("archive_id", F.col("manifest_hash").alias("source_manifest_hash")),
                   "archive_id"))
    down = F.col("direction") == "downstream"
    totals = around.groupBy(*key).agg(
        F.count_if(~down).alias("upstream_count"), F.count_if(down).alias("downstream_count"),
        F.max(F.when(down, F.col("distance")).otherwise(0)).alias("dependency_depth_max"))
    # Assessments that touch the anchor: built on it, itself, or citing it.
    touching = (known.filter(F.col("kind") == "assessment").select(*key, F.col("id").alias("assessment_id"))
                .unionByName(known.filter(F.col("kind") == "evidence").join(
                    targets("assessed_from", "id"), ["archive_id", "id"])
                    .select(*key, F.col("from_id").alias("assessment_id")))
                .unionByName(known.filter(is_source).join(targets("derived_from", "id"), ["archive_id", "id"])
                             .select(*key, F.col("from_id").alias("assessment_id"))))
    touching = touching.join(texts("authentication_assessments", "payload", "assessment_id"),
                             ["archive_id", "assessment_id"])
    counts = touching.groupBy(*key).agg(F.count("*").alias("assessment_count"))
    zero = ["upstream_count", "downstream_count", "dependency_depth_max", "assessment_count"]
    heads = heads.join(totals, key, "left").join(counts, key, "left").fillna(0, zero)

    def close(direction: str) -> DataFrame:
        rows = around.filter(F.col("direction") == direction)
        order = F.concat_ws(_SEP, F.lpad(F.col("distance").cast("string"), 10, "0"), "node_kind", "node_id")
        text = canon.canonical_struct({"distance_from_anchor": (F.col("distance"), schemas.L),
                                       "node_id": (F.col("node_id"), schemas.S),
                                       "node_type": (F.col("node_kind"), schemas.S)})
        return items(rows, key, order, text)

    def affected(kind: str) -> DataFrame:
        rows = around.filter(down & (F.col("node_kind") == kind))
        return items(rows, key, F.col("node_id"), canon.json_text(F.col("node_id")))

    version = F.lit(f'"{schemas.SCHEMA_VERSION}"')
    engine = F.lit(f'"{schemas.ENGINE_VERSION}"')
    built = record_digest(heads, key, {
        "anchor_node_id": _text("id"),
        "anchor_node_kind": _text("kind"),
        "assembly_engine_version": engine,
        "assembly_method_name": F.lit(f'"{schemas.ASSEMBLY_METHOD}"'),
        "derived_assessments": items(touching, key, F.col("assessment_id"), F.col("payload")),
        "evidence": F.coalesce("evidence", F.lit("null")),
        "graph_neighborhood": {"downstream": close("downstream"), "upstream": close("upstream")},
        "impact_report": {
            "affected_assessments": affected("assessment"),
            "affected_evidence": affected("evidence"),
            "analysis_engine_version": engine,
            "dependency_depth_max": F.col("dependency_depth_max").cast("string"),
            "root_node_id": _text("id"),
            "schema_version": version,
            "total_affected_nodes": F.col("downstream_count").cast("string")},
        "provenance": F.coalesce("provenance", F.lit("null")),
        "schema_version": version,
        "source": F.coalesce("source", F.lit("null")),
        "source_manifest_hash": _text("source_manifest_hash")}, "context_bundle_hash")
    return built.select(*key, "evidence_id", "source_id", "assessment_count", "upstream_count",
                        "downstream_count", "dependency_depth_max", "source_manifest_hash",
                        "context_bundle_hash"), around
