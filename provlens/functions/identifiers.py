"""Identifier formats, kind inference and fixed texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from provlens.schemas import KIND_KEYS, NAMESPACE

HEX64 = "^[a-f0-9]{64}$"

# Media types by kind and kinds by file suffix.
MIME_BY_KIND = {
    "document_scan": "application/pdf",
    "document_text": "text/plain",
    "still_image": "image/png",
    "moving_image": "video/mp4",
    "audio_recording": "audio/wav",
}
OTHER_MIME = "application/octet-stream"
SUFFIXES_BY_KIND = {
    "document_text": [".txt", ".md"],
    "still_image": [".png", ".jpg", ".jpeg", ".tiff", ".tif"],
    "moving_image": [".mp4", ".mkv", ".mov", ".avi"],
    "audio_recording": [".wav", ".flac", ".mp3", ".ogg"],
}

# The text that explains each assessment status.
RATIONALES = {
    "unverified": "No hay fuentes documentadas en el archive para esta evidencia.",
    "partially_supported": "Hay al menos una fuente documentada, pero la cadena de procedencia "
                           "no declara pasos: la cadena de custodia está vacía.",
    "supported": "Hay fuentes documentadas y pasos de procedencia; todas las "
                 "referencias del archive se resuelven.",
    "contradicted": "El archive tiene al menos una referencia rota: Source o "
                    "origin_source_id referenciados no existen en este archive.",
    "unknown": "Estado de inicialización; ninguna regla V1 emite UNKNOWN.",
}


def ref_hash(kind: Column, identifier: Column) -> Column:
    return F.sha2(F.concat_ws(":", kind, identifier), 256)


def assessment_id(evidence_id: Column, method: Column) -> Column:
    return F.concat_ws("__", evidence_id, method)


def step_id(evidence_hash: Column, number: Column) -> Column:
    return F.format_string("%s__step%05d", evidence_hash, number)


def evidence_uri(evidence_hash: Column, namespace: str = NAMESPACE) -> Column:
    return F.concat(F.lit(f"{namespace}:evidence/sha256:"), evidence_hash)


def uri_hash(target: Column) -> Column:
    """The hash in an evidence URI of any namespace, else null."""
    found = F.regexp_extract(target, "^[A-Za-z][A-Za-z0-9]*:evidence/sha256:([a-f0-9]{64})$", 1)
    return F.nullif(found, F.lit(""))


def normalize_hash(text: Column) -> Column:
    """Bare hex from ``<hex>``, ``sha256:<hex>`` or a full URI; null when malformed."""
    found = F.regexp_extract(
        F.trim(text), "^(?:(?:[A-Za-z][A-Za-z0-9]*:evidence/)?sha256:)?([a-f0-9]{64})$", 1)
    return F.nullif(found, F.lit(""))


def object_uri(blob_hash: Column) -> Column:
    return F.concat(F.lit("objects/sha256/"), F.substring(blob_hash, 1, 2), F.lit("/"),
                    F.substring(blob_hash, 3, 62))


def infer_kind(path: Column, mime: Column) -> Column:
    name = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    suffix = F.regexp_extract(name, "^.+(\\.[^.]+)$", 1)
    scan = F.coalesce(mime == "application/pdf", F.lit(False)) | (suffix == ".pdf")
    out = F.when(scan, F.lit("document_scan"))
    for kind, suffixes in SUFFIXES_BY_KIND.items():
        out = out.when(suffix.isin(suffixes), F.lit(kind))
    return out.otherwise(F.lit("document_scan"))


def _lookup(table: dict[str, str], key: Column, default: str | None) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default).cast("string"))


def infer_mime(kind: Column) -> Column:
    return _lookup(MIME_BY_KIND, kind, OTHER_MIME)


def rationale(status: Column) -> Column:
    return _lookup(RATIONALES, status, None)


def iso_second(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def key_fingerprint(pem: Column) -> Column:
    """SHA-256 of the DER bytes inside a PEM block."""
    body = F.regexp_replace(F.regexp_replace(pem, "-----[A-Z ]+-----", ""), "\\s", "")
    return F.sha2(F.unbase64(body), 256)


def detect_kind(text: Column) -> Column:
    """Artifact kind from the top-level keys of JSON text; null when none fits."""
    keys = F.json_object_keys(text)
    picks = [F.when(F.size(F.array_except(F.array(*map(F.lit, need)), keys)) == 0, F.lit(kind))
             for kind, need in KIND_KEYS]
    return reduce(lambda a, b: F.coalesce(a, b), picks)
