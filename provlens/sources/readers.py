"""Scans over a folder of archives, ``<root>/<archive_id>/…``.

``archive_id`` comes from the path, so one scan covers every archive.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlens import schemas
from provlens.functions.canonical import self_hash
from provlens.functions.ordered import sequenced
from provlens.session import landed
from provlens.sources.archive_files import SLICES, can_open, read_files, read_rows

# Folders inside an archive.
ARTIFACT_DIRS = {"workspace": "workspaces", "timeline": "timelines", "snapshot": "snapshots",
                 "justification": "justifications", "attestation": "attestations"}
SIDECAR_DIRS = {"certificate": "capture-certificates", "inference_proof": "inference-proofs"}

_TIMES = {"evidence": ["ingested_at"], "provenance": ["attested_at"],
          "authentication_assessments": ["created_at"]}


def _archive_id(root: str) -> Column:
    """The path part after the whole of ``root``; file paths are percent-encoded URIs.

    A file that does not lie under ``root`` fails the scan.
    """
    spark = SparkSession.active()
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
    file = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "\\+", "%2B"))
    found = F.regexp_extract(file, f"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?\\Q{whole}\\E/(?:archive_id=)?([^/]+)/", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit(f"not under {whole}: "), file)))


def _row_files(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``archive_id, row_id, n, row_hash, payload_jcs`` of every file of one table.

    A table has as many files as rows, so tasks list and read them; the driver lists the archives only.
    """
    under = f"{root}/*/tables/{table}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = system.makeQualified(path).toUri()
    place = whole.getPath() if whole.getScheme() == "file" else whole.toString()
    archives = len(system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(under)) or [])
    if archives and can_open(place):
        files = read_rows(spark, place, table, max(SLICES, -(-2 * spark.sparkContext.defaultParallelism // archives)))
    else:
        # Where pyarrow.fs cannot read, or there is no such table, which is an error.
        raw = spark.read.schema("row_hash string, payload_jcs binary").option("ignoreCorruptFiles", "true").parquet(under)
        files = raw.select(_archive_id(root).alias("archive_id"), F.col("_metadata.file_path").alias("name"),
                           F.lit(1).cast("long").alias("n"), "row_hash", "payload_jcs")
    return files.select("archive_id", F.regexp_extract("name", "([^/]+)\\.parquet$", 1).alias("row_id"), "n",
                        F.col("row_hash").cast("string").alias("row_hash"), "payload_jcs")


def scan_rows(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``archive_id, table, row_id, row_hash, payload`` of one table."""
    rows = _row_files(spark, root, table).select(
        "archive_id", F.lit(table).alias("table"), "row_id", "n", "row_hash", F.decode("payload_jcs", "UTF-8").alias("payload"))
    single = rows.groupBy("archive_id", "table", "row_id").agg(
        F.sum("n").alias("n"), F.first("row_hash").alias("row_hash"), F.first("payload").alias("payload"))
    return single.filter("n = 1").drop("n")


def parse_rows(rows: DataFrame, table: str) -> DataFrame:
    """Typed columns of scanned rows; rows that are no JSON object drop out."""
    schema = schemas.PAYLOADS[table]
    out = (rows.withColumn("p", F.from_json("payload", schema)).filter("p IS NOT NULL")
           .select("archive_id", "row_id", "row_hash", "p.*"))
    for c in _TIMES.get(table, []):
        out = out.withColumn(c, F.to_timestamp(c))
    return out.withColumn("first_seen", F.to_date("first_seen")) if table == "sources" else out


def scan_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return parse_rows(scan_rows(spark, root, table), table)


def lookup(df: DataFrame, id_column: str, row_id: str) -> DataFrame:
    """Rows of one identity; the filter reaches the Parquet scan of a typed table."""
    return df.filter(F.col(id_column) == row_id)


def scan_blobs(spark: SparkSession, root: str, content: bool = False, digest: bool = False) -> DataFrame:
    """Blob hashes from object paths; without ``content`` or ``digest`` no bytes are read.

    ``digest`` adds ``sha256`` of the bytes, read piece by piece, so that blobs of any size are
    checked; ``content`` holds a blob in its row.
    """
    read = "digest" if digest else "bytes" if content else "none"
    files = read_files(spark, root, "objects/sha256/??/*", content=read)
    name = F.split("path", "/")
    out = files.select("archive_id", F.concat(name[2], name[3]).alias("hash"), "size_bytes",
                       *(["content"] if content else []), *(["sha256"] if digest else []))
    return out.filter(F.length("hash") == 64)


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders that are listed inside share a few tasks a core; by default each has one of its own."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scan_audit(spark: SparkSession, root: str, strict: bool = True, pattern: str = "audit.log") -> DataFrame:
    """Audit entries with their dense line position ``pos``.

    Lines are read in splits, so one log may be as large as it likes, or be a folder
    of part files: file name, block start and row number in the split give the order.
    Many logs are many small files, so they are opened once and the lines written to a table.
    """
    with _few_listing_tasks(spark):
        files = spark.read.text(f"{root}/*/{pattern}")
    lines = (files
             .select(_archive_id(root).alias("archive_id"), "value",
                     F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line"))
             .filter(F.length(F.trim("value")) > 0))
    placed = sequenced(landed(lines), ["archive_id"], ["path", "block", "line"])
    schema = T.StructType(schemas.AUDIT_ENTRY.fields + [T.StructField("_bad", T.StringType())])
    mode = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    shape = schemas.AUDIT_ENTRY if strict else schema
    parsed = placed.select("archive_id", F.col("position").alias("pos"),
                           F.from_json("value", shape, mode).alias("e"))
    if not strict:
        parsed = parsed.filter("e IS NOT NULL AND e._bad IS NULL")
    return parsed.select("archive_id", "pos", *[F.col(f"e.{f.name}") for f in schemas.AUDIT_ENTRY.fields])


def _scan_json(spark: SparkSession, root: str, pattern: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """JSON files as ``archive_id, path, artifact_name, text`` and the parsed record ``r``.

    Every file that fits is a row: an empty or unreadable one, or one that is no UTF-8, has no
    record. With ``lines`` the files are Spark's own, with one artifact per line.
    """
    full = T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])
    record = F.from_json("text", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")
    if lines:
        files = spark.read.text(f"{root}/*/{pattern}").select(
            _archive_id(root).alias("archive_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    else:
        files = read_files(spark, root, pattern, content="bytes").select(
            "archive_id", "path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return files.select("archive_id", "path", F.regexp_extract("path", "([^/]+)\\.json$", 1).alias("artifact_name"), "text", record)


def scan_artifacts(spark: SparkSession, root: str, kind: str, pattern: str | None = None,
                   lines: bool = False) -> DataFrame:
    """Landed artifacts of a kind; undecodable ones, empty ones among them, are rows with ``decode_error``.

    Names that begin with ``_`` or ``.`` are read like others; one that cannot be decoded is a
    ``hidden_file``. With ``lines`` the files hold one artifact per line, as the writers leave
    them, instead of one artifact per file.
    """
    schema, own = schemas.ARTIFACTS[kind]
    raw = _scan_json(spark, root, f"{ARTIFACT_DIRS[kind]}/*.json" if pattern is None else pattern, schema, lines=lines)
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | F.col(f"r.{own}").isNull()
    hidden = F.col("artifact_name").rlike("^[_.]")
    return raw.select("archive_id", "artifact_name", *[F.col(f"r.{f.name}") for f in schema.fields],
                      F.when(bad & hidden, F.lit("hidden_file")).when(bad, F.lit("ValueError")).alias("decode_error"))


def scan_artifact_texts(spark: SparkSession, root: str, pattern: str = "*/*.json") -> DataFrame:
    """Artifact JSON of any kind as text, for verification of loose files."""
    return _scan_json(spark, root, pattern, schemas.struct(kind=schemas.S)).select(
        "archive_id", "artifact_name", "text")


def scan_manifest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored manifests: headers, tables with counts, and the hash lists in long form."""
    table = schemas.struct(partition_hashes=schemas.STRINGS, row_count=schemas.L, schema_hash=schemas.S)
    schema = schemas.struct(schema_version=schemas.S, software_version=schemas.S, generated_at=schemas.S,
                            tables=T.MapType(schemas.S, table), blobs_root=schemas.S, notes=schemas.S)
    raw = _scan_json(spark, root, "manifest.json", schema).filter("r IS NOT NULL AND r._bad IS NULL")
    heads = raw.select("archive_id", "r.schema_version", "r.software_version",
                       F.to_timestamp("r.generated_at").alias("generated_at"), "r.blobs_root", "r.notes")
    tables = raw.select("archive_id", F.explode("r.tables").alias("table", "t")).select(
        "archive_id", "table", "t.row_count", "t.schema_hash",
        F.sha2(F.concat(F.lit("["), F.array_join(
            F.transform("t.partition_hashes", lambda h: F.concat(F.lit('"'), h, F.lit('"'))), ","),
            F.lit("]")), 256).alias("partition_digest"), "t.partition_hashes")
    hashes = tables.select("archive_id", "table", F.explode("partition_hashes").alias("row_hash"))
    return heads, tables.drop("partition_hashes"), hashes


def scan_transparency(spark: SparkSession, root: str) -> DataFrame:
    """Log manifests; only files named ``manifest-NNNNNN.json`` count."""
    raw = _scan_json(spark, root, "transparency/*.json", schemas.TRANSPARENCY)
    return (raw.filter(F.col("artifact_name").rlike("^manifest-\\d{6,}$"))
            .filter("r IS NOT NULL AND r._bad IS NULL")
            .select("archive_id", *[F.col(f"r.{f.name}") for f in schemas.TRANSPARENCY.fields]))


def scan_witnesses(spark: SparkSession, root: str) -> DataFrame:
    """Witness attestations per manifest folder; bad files are skipped."""
    raw = _scan_json(spark, root, "transparency/witnesses/**/*.json", schemas.WITNESS)
    at = F.regexp_extract("path", "witnesses/manifest-(\\d{6,})/[a-f0-9]{64}\\.json$", 1)
    return (raw.withColumn("sequence", F.nullif(at, F.lit("")).cast("long"))
            .filter("sequence IS NOT NULL AND r._bad IS NULL AND r.attestation_hash IS NOT NULL")
            .select("archive_id", "sequence", *[F.col(f"r.{f.name}") for f in schemas.WITNESS.fields]))


def scan_sidecars(spark: SparkSession, root: str, kind: str, pattern: str | None = None,
                  lines: bool = False) -> DataFrame:
    """Capture certificates or inference proofs; undecodable ones are skipped."""
    schema, own = schemas.ARTIFACTS[kind]
    raw = _scan_json(spark, root, f"{SIDECAR_DIRS[kind]}/*.json" if pattern is None else pattern, schema, lines=lines)
    return (raw.filter(F.col("r._bad").isNull() & F.col(f"r.{own}").isNotNull())
            .select("archive_id", "artifact_name", *[F.col(f"r.{f.name}") for f in schema.fields]))


def scan_media_reports(spark: SparkSession, root: str, folder: str = "c2pa") -> DataFrame:
    """Media-provenance reports, one row per manifest of a chain."""
    assertion = schemas.struct(label=schemas.S, data=schemas.STRING_MAP)
    signature = schemas.struct(chain_verified=schemas.B)
    manifest = schemas.struct(label=schemas.S, parent_manifest_label=schemas.S,
                              signature_info=signature, assertions=T.ArrayType(assertion))
    schema = schemas.struct(evidence_sha256=schemas.S, report_hash=schemas.S, manifests=T.ArrayType(manifest))
    raw = _scan_json(spark, root, f"{folder}/*.json", schema).filter("r._bad IS NULL")
    rows = raw.select("archive_id", "r.evidence_sha256", F.explode("r.manifests").alias("m"))
    bound = F.filter("m.assertions", lambda a: a["label"] == "c2pa.hash.data")
    return rows.select("archive_id", "evidence_sha256", "m.label",
                       F.col("m.parent_manifest_label").alias("parent_label"),
                       F.col("m.signature_info.chain_verified").alias("signature_verified"),
                       F.element_at(F.try_element_at(bound, F.lit(1))["data"], "sha256").alias("declared_sha256"))


def scan_key_declarations(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Declared keys (``role, owner_id, public_key_fingerprint``) and their published references."""
    reference = schemas.struct(kind=schemas.S, uri=schemas.S, note=schemas.S)
    operator = schemas.struct(operator_id=schemas.S, public_key_fingerprint=schemas.S,
                              external_references=T.ArrayType(reference))
    witness = schemas.struct(witness_operator_id=schemas.S, public_key_fingerprint=schemas.S,
                             external_references=T.ArrayType(reference))
    schema = schemas.struct(operator=operator, witnesses=T.ArrayType(witness))
    raw = _scan_json(spark, root, "transparency/key-declaration.json", schema).filter("r._bad IS NULL")
    one = raw.select("archive_id", F.lit("operator").alias("role"), "r.operator.*").withColumnRenamed(
        "operator_id", "owner_id")
    many = raw.select("archive_id", F.explode("r.witnesses").alias("w")).select(
        "archive_id", F.lit("witness").alias("role"), "w.*").withColumnRenamed("witness_operator_id", "owner_id")
    keys = one.unionByName(many)
    references = keys.select("archive_id", F.col("public_key_fingerprint").alias("declared_fingerprint"),
                             F.explode("external_references").alias("x")).select(
        "archive_id", "x.kind", "x.uri", "declared_fingerprint")
    return keys.drop("external_references"), references


def with_self_hash(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("computed_hash", self_hash(df, kind))
