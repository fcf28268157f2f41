"""Counts, facets, manifests and newest-of-each summaries.

All are hash aggregates with partial sums on the map side; "newest" and "first"
use ``max_by``/``min_by`` so no group is gathered or sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlens import schemas
from provlens.functions import canonical as canon
from provlens.functions.documents import items, segments_digest
from provlens.functions.ordered import document_digest
from provlens.session import stable


# --- manifests -----------------------------------------------------------------------------


def _pick(values: dict, key):
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _schema_hash(table):
    return F.sha2(F.concat(F.lit("schema:"), table), 256)


def table_counts(rows: DataFrame, archives: DataFrame) -> DataFrame:
    """Row count and schema hash of each of the five tables, empty ones included."""
    slots = archives.select("archive_id", F.explode(F.array(*map(F.lit, schemas.TABLES))).alias("table"))
    counts = rows.groupBy("archive_id", "table").agg(F.count("*").alias("row_count"))
    return (slots.join(counts, ["archive_id", "table"], "left")
            .withColumn("row_count", F.coalesce("row_count", F.lit(0)))
            .withColumn("schema_hash", _schema_hash(F.col("table"))))


def _hashes(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return items(rows, keys, F.col(name), canon.json_text(F.col(name)))


def table_manifest(rows: DataFrame, archives: DataFrame) -> DataFrame:
    """Per table: row count, schema hash and the digest of its sorted hash list.

    ``rows`` has ``archive_id, table, row_hash`` and is itself the long form of the
    list; two lists are equal exactly when their digests are.
    """
    keys = ["archive_id", "table"]
    return segments_digest(table_counts(rows, archives), keys,
                           [F.lit("["), _hashes(rows, keys, "row_hash"), F.lit("]")], "partition_digest")


def blobs_root(blobs: DataFrame, archives: DataFrame) -> DataFrame:
    """Digest of the sorted list of blob hashes of each archive."""
    keys = ["archive_id"]
    return segments_digest(archives.select(*keys), keys,
                           [F.lit("["), _hashes(blobs, keys, "hash"), F.lit("]")], "blobs_root")


def archive_manifest(rows: DataFrame, blobs: DataFrame, archives: DataFrame,
                     software_version: str, schema_version: str = schemas.SCHEMA_VERSION) -> DataFrame:
    """Manifest header and hash of every archive.

    ``archives`` has ``archive_id``, ``generated_at`` (timestamp) and may have
    ``notes``. Sections alternate between fixed text and the sorted hash lists.
    """
    if "notes" not in archives.columns:
        archives = archives.withColumn("notes", F.lit(None).cast("string"))
    names = sorted(schemas.TABLES)
    header = stable(archives.join(blobs_root(blobs, archives), "archive_id")
                    .withColumn("schema_version", F.lit(schema_version))
                    .withColumn("software_version", F.lit(software_version)))
    fields = ["blobs_root", "generated_at", "notes", "schema_version", "software_version"]
    head = canon.canonical_struct({n: (F.col(n), header.schema[n].dataType) for n in fields})
    opening = F.concat(F.substring(head, F.lit(1), F.length(head) - 1),
                       F.lit(f',"tables":{{"{names[0]}":{{"partition_hashes":['))
    # What follows the list of a table: its counts, then the start of the next table.
    follow = {a: f'}},"{b}":{{"partition_hashes":[' for a, b in zip(names, names[1:])} | {names[-1]: "}}}"}
    closing = F.concat(F.lit('],"row_count":'), F.col("row_count").cast("string"),
                       F.lit(',"schema_hash":"'), F.col("schema_hash"), F.lit('"'),
                       _pick(follow, F.col("table")))
    at = 2 * _pick({t: i for i, t in enumerate(names)}, F.col("table")).cast("long")

    def text(df: DataFrame, part, ord, item: bool, body) -> DataFrame:
        return df.select("archive_id", part.alias("part"), ord.alias("ord"), F.lit(item).alias("item"),
                         body.alias("text"))

    fragments = (text(header, F.lit(0).cast("long"), F.lit(""), False, opening)
                 .unionByName(text(rows, at + 1, F.col("row_hash"), True, canon.json_text(F.col("row_hash"))))
                 .unionByName(text(table_counts(rows, archives), at + 2, F.lit(""), False, closing)))
    hashes = document_digest(fragments, ["archive_id"]).withColumnRenamed("digest", "manifest_hash")
    return header.join(hashes, "archive_id")


# --- counts and facets ---------------------------------------------------------------------


def archive_counts(manifests: DataFrame, heads: DataFrame, **artifacts: DataFrame) -> DataFrame:
    """The nine state columns of an archive.

    ``artifacts`` maps ``evidence``, ``attestation``, ``workspace``, ``timeline``,
    ``snapshot`` and ``justification`` to frames with ``archive_id``.
    """
    names = ("evidence", "attestation", "workspace", "timeline", "snapshot", "justification")
    tagged = reduce(DataFrame.unionByName, [
        artifacts[n].groupBy("archive_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(n))
        for n in names if n in artifacts])
    counts = tagged.groupBy("archive_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).alias(f"{n}_count")
        for n in names])
    return (manifests.select("archive_id", F.col("manifest_hash").alias("archive_manifest_hash"))
            .join(heads.select("archive_id", F.col("head_hash").alias("audit_chain_head_hash"),
                               F.col("total").alias("audit_entry_count")), "archive_id")
            .join(counts, "archive_id", "left")
            .fillna(0, [f"{n}_count" for n in names]))


def action_counts(log: DataFrame) -> DataFrame:
    return (log.groupBy("archive_id", "action").agg(F.count("*").alias("count"))
            .orderBy("archive_id", F.desc("count"), "action"))


def kind_counts(evidence: DataFrame) -> DataFrame:
    """Facet per kind with the archive total in the row where ``kind`` is ``*``."""
    return (evidence.groupingSets([["archive_id", "kind"], ["archive_id"]], "archive_id", "kind")
            .agg(F.count("*").alias("count"), F.grouping("kind").alias("is_total"))
            .select("archive_id",
                    F.when(F.col("is_total") == 1, F.lit("*")).otherwise(F.col("kind")).alias("kind"),
                    "count"))


def case_state_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("archive_id").agg(
        F.count_if(F.col("conclusion").isNull() | (F.col("conclusion") == "")).alias("open"),
        *[F.count_if(F.col("conclusion") == c).alias(c) for c in schemas.CONCLUSIONS])


def impact_summary(impact: DataFrame) -> DataFrame:
    """Counts and depth over ``impact`` rows, which are the affected lists in long form."""
    return impact.groupBy("archive_id", "root_kind", "root_id").agg(
        F.count_if(F.col("node_kind") == "assessment").alias("affected_assessments"),
        F.count_if(F.col("node_kind") == "evidence").alias("affected_evidence"),
        F.max("distance").alias("dependency_depth_max"),
        F.count("*").alias("total_affected_nodes"))


def witness_totals(witnesses: DataFrame) -> DataFrame:
    return (witnesses.groupBy("archive_id", F.col("target_manifest_sequence").alias("sequence"))
            .agg(F.count("*").alias("witness_count")))


def witness_summary(totals: DataFrame) -> DataFrame:
    return totals.groupBy("archive_id").agg(
        F.sum("witness_count").alias("total_witnesses"),
        F.count("*").alias("manifests_with_witnesses"))


def timeline_bounds(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.min("observed_at").alias("first_timestamp"), F.max("observed_at").alias("last_timestamp"),
        F.count("*").alias("event_count"))


def log_status(manifests: DataFrame) -> DataFrame:
    """Manifest count, gaps and head of each transparency log."""
    head = F.max_by(F.struct("sequence", "manifest_hash", "audit_chain_head_hash",
                             "audit_entry_count", "signed_at", "operator_id"), "sequence")
    return (manifests.groupBy("archive_id")
            .agg(F.count("*").alias("manifest_count"),
                 (F.max("sequence") - F.min("sequence") + 1 - F.count("*")).alias("gap_count"),
                 head.alias("head"))
            .select("archive_id", "manifest_count", "gap_count", (F.col("gap_count") == 0).alias("ok"),
                    "head.*"))


def layer_counts(events: DataFrame) -> DataFrame:
    """Events per layer and number of active layers of each evidence."""
    kinds = ("capture", "ingest", "manifest", "proof")
    counts = events.groupBy("archive_id", "hash").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return counts.withColumn(
        "active_layers", reduce(lambda a, b: a + b, [(F.col(k) > 0).cast("long") for k in kinds]))


def latest_by_target(log: DataFrame) -> DataFrame:
    """Newest entry of a derived action for each target."""
    return (log.filter(F.col("action").isin(list(schemas.DERIVED_ACTIONS)))
            .groupBy("archive_id", "target")
            .agg(F.max_by(F.struct("seq", "action", "parameters"), "pos").alias("entry"))
            .select("archive_id", "target", "entry.*"))


def latest_ingest(log: DataFrame) -> DataFrame:
    """Newest ingest parameters of each evidence."""
    name = F.lower(F.regexp_extract("target", "^.*sha256:(.*)$", 1))
    return (log.filter((F.col("action") == "ingest_evidence") & F.contains("target", F.lit("sha256:")))
            .groupBy("archive_id", name.alias("hash"))
            .agg(F.max_by("parameters", "pos").alias("parameters")))


def integrity_summary(issues: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Checked artifacts, issues and verdict per archive.

    ``artifacts`` has one row per checked artifact with ``archive_id, artifact_kind``.
    """
    kinds = ("workspace", "timeline", "snapshot", "justification", "attestation", "assessment")
    checked = artifacts.groupBy("archive_id").agg(
        *[F.count_if(F.col("artifact_kind") == k).alias(f"{k}s_checked") for k in kinds],
        F.count("*").alias("total_checked"))
    found = issues.groupBy("archive_id").agg(F.count("*").alias("issue_count"))
    return (checked.join(found, "archive_id", "left")
            .withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))
            .withColumn("ok", F.col("issue_count") == 0))


def header_consensus(headers: DataFrame, min_agreement: int = 2) -> DataFrame:
    """One header per height, and enough different sources that returned it.

    A source that reports a height several times counts once; if its reports differ, the
    height is in disagreement.
    """
    per_source = headers.groupBy("height", "source").agg(F.min("header_hex").alias("low"), F.max("header_hex").alias("high"))
    low, high = F.min("low"), F.max("high")
    return (per_source.groupBy("height")
            .agg(F.count("*").alias("sources"), low.alias("header_hex"), (low == high).alias("same"))
            .withColumn("status", F.when(~F.col("same"), F.lit("disagreement"))
                        .when(F.col("sources") < min_agreement, F.lit("too_few_sources"))
                        .otherwise(F.lit("agreed")))
            .select("height", "sources", "status",
                    F.when(F.col("status") == "agreed", F.col("header_hex")).alias("header_hex"),
                    F.when(F.col("status") == "agreed", F.lower(F.substring("header_hex", 73, 64)))
                    .alias("merkle_root")))
