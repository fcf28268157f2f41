"""Sinks: upserts by identity, canonical artifact files and the log index."""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyarrow import parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlens import schemas
from provlens.functions.canonical import canonical_struct
from provlens.operators import aggregates, chains
from provlens.sources.archive_files import write_files


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table after writing ``incoming`` by identity; the last write of a key wins.

    A row with the stored hash changes nothing. Write the result to a new path or
    overwrite partitions by ``archive_id``.
    """
    rest = [c for c in stored.columns if c not in keys]
    newest = (incoming.groupBy(*keys)
              .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*"))
    changed = newest.join(stored.select(*keys, "row_hash"), [*keys, "row_hash"], "left_anti")
    return stored.join(changed.select(*keys), keys, "left_anti").unionByName(changed.select(*stored.columns))


def artifact_lines(df: DataFrame, kind: str) -> DataFrame:
    """``archive_id, value``: one line of canonical JSON per artifact."""
    schema, _ = schemas.ARTIFACTS[kind]
    text = canonical_struct({f.name: (F.col(f.name), df.schema[f.name].dataType) for f in schema.fields})
    return df.select("archive_id", text.alias("value"))


def write_artifacts(df: DataFrame, kind: str, path: str) -> None:
    artifact_lines(df, kind).write.mode("overwrite").partitionBy("archive_id").text(path)


def write_artifact_files(df: DataFrame, kind: str, folder: str, name: str, root: str) -> None:
    """One canonical JSON file per artifact, ``<folder>/<column name>.json`` below its archive."""
    schema, _ = schemas.ARTIFACTS[kind]
    text = canonical_struct({f.name: (F.col(f.name), df.schema[f.name].dataType) for f in schema.fields})
    write_files(df.select("archive_id", F.concat(F.lit(f"{folder}/"), F.col(name), F.lit(".json")).alias("path"),
                          text.alias("content")), root)


def write_rows(rows: DataFrame, root: str) -> None:
    """Stored rows (``archive_id, table, row_id, row_hash, payload``) as Parquet files of one row each."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            archive, path, hashes, payloads = (c.to_pylist() for c in batch.columns)
            files = []
            for h, payload in zip(hashes, payloads):
                out = BytesIO()
                parquet.write_table(pa.table({"row_hash": pa.array([h], pa.string()), "payload_jcs": pa.array([payload], pa.binary())}),
                                    out, compression="zstd", use_dictionary=False)
                files.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(archive, pa.string()), pa.array(path, pa.string()), pa.array(files, pa.binary())],
                                             ["archive_id", "path", "content"])

    path = F.concat(F.lit("tables/"), "table", F.lit("/"), "row_id", F.lit(".parquet"))
    write_files(rows.select("archive_id", path.alias("path"), "row_hash", F.col("payload").cast("binary"))
                .mapInArrow(packed, "archive_id string, path string, content binary"), root)


def write_table(df: DataFrame, path: str) -> None:
    """Typed Parquet, partitioned by archive so later scans prune to one."""
    df.write.mode("overwrite").partitionBy("archive_id").parquet(path)


def export_log_index(manifests: DataFrame, witnesses: DataFrame,
                     anchors: DataFrame | None = None) -> DataFrame:
    """Per log manifest: its summary, its witnesses and its anchoring.

    ``anchors``: ``archive_id, sequence, notarized, anchored``.
    """
    totals = aggregates.witness_totals(witnesses)
    out = (manifests.select(
        "archive_id", "sequence",
        F.format_string("manifest-%06d.json", "sequence").alias("filename"),
        "manifest_hash", "previous_manifest_hash", "audit_chain_head_hash", "audit_entry_count",
        "evidence_count", "attestation_count", "workspace_count", "timeline_count", "snapshot_count",
        "justification_count", "signed_at", "operator_id", "public_key_fingerprint")
        .join(totals, ["archive_id", "sequence"], "left")
        .withColumn("witness_count", F.coalesce("witness_count", F.lit(0))))
    if anchors is None:
        return out.withColumn("notarized", F.lit(False)).withColumn("anchored", F.lit(False))
    return (out.join(anchors, ["archive_id", "sequence"], "left")
            .fillna(False, ["notarized", "anchored"]))


def log_index_totals(index: DataFrame) -> DataFrame:
    """The head and totals of an exported log index."""
    head = chains.head_manifest(index).select(
        "archive_id", F.col("sequence").alias("head_sequence"), F.col("manifest_hash").alias("head_hash"))
    sums = index.groupBy("archive_id").agg(
        F.count("*").alias("manifest_count"), F.sum("witness_count").alias("total_witnesses"),
        F.count_if(F.col("witness_count") > 0).alias("manifests_with_witnesses"),
        F.count_if("notarized").alias("notarized_count"), F.count_if("anchored").alias("anchored_count"))
    return sums.join(head, "archive_id")
