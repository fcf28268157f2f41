"""Folder scans, tampering, artifacts, ingest, reports and streams on small archives."""

import json
import os
import pathlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from provlens import schemas
from provlens.functions import canonical as c
from provlens.operators import aggregates, artifacts, chains, filters, joins, media, proofs, sets
from provlens.plans import ingest, report, verify
from provlens.sources import readers, writers
from provlens.streaming import streams
from tests.conftest import canon, chain, sha

H = [sha(f"blob{i}") for i in range(4)]


def ddl(schema):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def evidence_payload(i, source="s1"):
    return {"hash": H[i], "kind": "document_text", "content_uri": f"objects/sha256/{H[i][:2]}/{H[i][2:]}",
            "size_bytes": 5, "mime_type": "text/plain", "source_id": source, "status": "active",
            "authentication": {"status": "unverified", "assessor": None, "assessed_at": None, "method": None,
                               "notes": None},
            "ingested_at": f"2026-01-0{i + 1}T00:00:00Z", "ingested_by": "op", "schema_version": "0.1.0",
            "notes": "línea\n1", "intrinsic_metadata": {"b": "1", "a": "\x1f"}}


def self_hashed(record, own):
    return {**record, own: sha(canon({k: v for k, v in record.items() if k != own}))}


WORKSPACE = self_hashed({"workspace_id": "w", "title": "T", "references": [
    {"reference_type": "evidence", "identifier": H[0], "artifact_hash": sha(f"evidence:{H[0]}")},
    {"reference_type": "evidence", "identifier": "gone", "artifact_hash": sha("evidence:gone")}],
    "source_manifest_hash": "1" * 64, "schema_version": "1"}, "workspace_hash")
CERTIFICATE = self_hashed({
    "certificate_type": "prov.capture.certificate.v1", "schema_version": "1", "evidence_sha256": H[0], "operator_id": "o",
    "captured_at": "2026-01-01T00:00:00Z", "device_id": "d", "location": None, "notes": None,
    "public_key_fingerprint": "2" * 64, "signature": "3" * 128, "signature_algorithm": "ed25519"}, "certificate_hash")


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def write_row(folder, row_id, payload, row_hash=None, n=1):
    folder.mkdir(parents=True, exist_ok=True)
    text = canon(payload) if isinstance(payload, dict) else payload
    pq.write_table(pa.table({"row_hash": [row_hash or sha(text)] * n, "payload_jcs": [text.encode()] * n}),
                   folder / f"{row_id}.parquet")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("archives")
    for name in ("one", "two"):
        a = base / name
        rows = a / "tables" / "evidence"
        for i in range(3):
            write_row(rows, H[i], evidence_payload(i))
        if name == "two":
            write_row(rows, H[3], evidence_payload(3), row_hash="0" * 64)          # wrong hash
            write_row(rows, "double", evidence_payload(3), n=2)                      # not one row
            write_row(rows, "loose", '{"b": 1, "a": 2}')                           # not canonical
            (rows / "broken.parquet").write_bytes(b"no parquet")
        for i in range(2):
            blob = a / "objects" / "sha256" / H[i][:2] / H[i][2:]
            blob.parent.mkdir(parents=True, exist_ok=True)
            blob.write_bytes(f"blob{i}".encode() if name == "one" else b"other")
        write(a / "objects" / "sha256" / "ab" / "short", "x")
        lines = [json.dumps({k: v for k, v in r.items() if k not in ("archive_id", "pos")}) for r in chain(name, 5)]
        if name == "two":
            lines.insert(2, "{broken")
        write(a / "audit.log", "\n".join(lines) + "\n\n")
        write(a / "workspaces" / "w.json", json.dumps(WORKSPACE, indent=2))
        write(a / "workspaces" / "bad.json", "{nothing")
        write(a / "capture-certificates" / f"{CERTIFICATE['certificate_hash']}.json", json.dumps(CERTIFICATE))
        write(a / "capture-certificates" / "bad.json", "[]")
        write(a / "manifest.json", json.dumps({
            "schema_version": "0.1.0", "software_version": "9", "generated_at": "2026-01-01T00:00:00Z",
            "tables": {"evidence": {"partition_hashes": sorted(H[:2]), "row_count": 2, "schema_hash": sha("schema:evidence")}},
            "blobs_root": sha(canon(sorted(H[:2]))), "notes": None}))
        for i in (0, 2):
            m = {f.name: 0 if f.dataType.simpleString() == "bigint" else "x" for f in schemas.TRANSPARENCY.fields}
            write(a / "transparency" / f"manifest-{i:06d}.json", json.dumps({**m, "sequence": i}))
            w = {f.name: 0 if f.dataType.simpleString() == "bigint" else "x" for f in schemas.WITNESS.fields}
            write(a / "transparency" / "witnesses" / f"manifest-{i:06d}" / f"{sha(str(i))}.json", json.dumps(w))
        write(a / "transparency" / "latest.json", "{}")
        write(a / "transparency" / "witnesses" / "manifest-000000" / "note.json", "{}")
        write(a / "transparency" / "key-declaration.json", json.dumps({
            "operator": {"operator_id": "o", "public_key_fingerprint": "f0", "external_references": [
                {"kind": "https_pem", "uri": "https://x.example/k"}]},
            "witnesses": [{"witness_operator_id": "w", "public_key_fingerprint": "f1"}]}))
        write(a / "c2pa" / "r.json", json.dumps({"evidence_sha256": H[0], "report_hash": "x", "manifests": [
            {"label": "m1", "parent_manifest_label": None, "signature_info": {"chain_verified": True}, "assertions": []},
            {"label": "m2", "parent_manifest_label": "m1", "signature_info": {"chain_verified": True},
             "assertions": [{"label": "c2pa.hash.data", "data": {"sha256": H[0].upper()}}]}]}))
    return str(base)


def test_scan_rows_and_row_integrity(spark, root):
    rows = readers.scan_rows(spark, root, "evidence")
    got = {(r.archive_id, r.row_id) for r in rows.collect()}
    assert got == {(a, h) for a in ("one", "two") for h in H[:3]} | {("two", H[3]), ("two", "loose")}
    bad = verify.row_integrity(rows).filter("NOT hash_ok OR NOT canonical_ok").collect()
    assert {(r.archive_id, r.hash_ok, r.canonical_ok) for r in bad} == {("two", False, True), ("two", True, False)}
    table = readers.scan_table(spark, root, "evidence")
    one = readers.lookup(table, "hash", H[1]).filter("archive_id = 'one'").first()
    assert one.intrinsic_metadata == {"b": "1", "a": "\x1f"} and str(one.ingested_at) == "2026-01-02 00:00:00"


def test_scan_blobs(spark, root):
    blobs = readers.scan_blobs(spark, root, content=True)
    ok = {(r.archive_id, r.hash): r.ok for r in verify.blob_integrity(blobs).collect()}
    assert ok == {("one", H[0]): True, ("one", H[1]): True, ("two", H[0]): False, ("two", H[1]): False}
    names = readers.scan_blobs(spark, root)
    evidence = readers.scan_table(spark, root, "evidence").filter("length(hash) = 64")
    assert {(r.archive_id, r.hash) for r in joins.missing_blobs(evidence, names).collect()} == {
        ("one", H[2]), ("two", H[2]), ("two", H[3])}
    failed = verify.blob_failures(evidence.filter("archive_id = 'two'"), verify.blob_integrity(blobs)).collect()
    assert sorted((r.hash, r.failure) for r in failed) == sorted(
        [(H[0], "mismatch"), (H[1], "mismatch"), (H[2], "missing"), (H[3], "missing")])


def test_scan_audit(spark, root):
    lenient = readers.scan_audit(spark, root, strict=False)
    got = {}
    for r in lenient.collect():
        got.setdefault(r.archive_id, []).append((r.pos, r.seq))
    assert sorted(got["one"]) == [(i, i) for i in range(5)]
    assert sorted(got["two"]) == [(0, 0), (1, 1), (3, 2), (4, 3), (5, 4)]
    assert chains.verify_chain(lenient.filter("archive_id = 'one'")).first().ok
    with pytest.raises(Exception):
        readers.scan_audit(spark, root).collect()


def test_scan_artifacts_and_integrity(spark, root):
    found = readers.scan_artifacts(spark, root, "workspace")
    heads = verify.landed_headers(found, "workspace")
    state = {(r.archive_id, r.artifact_id): (r.declared_hash == r.computed_hash, r.decode_error) for r in heads.collect()}
    assert state[("one", "w")] == (True, None) and state[("two", "bad")][1] == "ValueError"
    refs = verify.landed_references(found.filter("decode_error IS NULL"), "workspace")
    evidence = readers.scan_table(spark, root, "evidence")
    empty = lambda s: spark.createDataFrame([], s)
    issues = verify.reference_issues(refs, evidence, empty("archive_id string, id string"),
                                     empty("archive_id string, assessment_id string"),
                                     empty("archive_id string, evidence_hash string")).collect()
    assert {(r.archive_id, r.issue_kind, r.detail) for r in issues} == {
        (a, "evidence_reference_dangling", "evidence 'gone' not found") for a in ("one", "two")}
    kinds = verify.header_issues(heads, empty("archive_id string, manifest_hash string")).collect()
    assert {(r.artifact_id, r.issue_kind) for r in kinds} == {("bad", "decode_error")}


def test_other_scans(spark, root):
    assert {(r.archive_id, r.sequence) for r in readers.scan_transparency(spark, root).collect()} == {
        (a, i) for a in ("one", "two") for i in (0, 2)}
    assert {(r.archive_id, r.sequence) for r in readers.scan_witnesses(spark, root).collect()} == {
        (a, i) for a in ("one", "two") for i in (0, 2)}
    certs = readers.scan_sidecars(spark, root, "certificate")
    assert [r.ok for r in certs.select((c.self_hash(certs, "certificate") == F.col("certificate_hash")).alias("ok")).collect()] == [True, True]
    keys, refs = readers.scan_key_declarations(spark, root)
    assert {(r.role, r.owner_id, r.public_key_fingerprint) for r in keys.collect()} == {
        ("operator", "o", "f0"), ("witness", "w", "f1")}
    fetched = spark.createDataFrame([("https_pem", "https://x.example/k", ["f0"])], "kind string, uri string, fingerprints array<string>")
    assert {r.status for r in joins.footprint_status(refs, fetched).collect()} == {"verified"}
    chains_ok = media.media_chain_status(readers.scan_media_reports(spark, root)).collect()
    assert [(r.chain_verified, r.failure_reason) for r in chains_ok] == [(True, None)] * 2


def test_stored_manifest_against_recomputed(spark, root):
    heads, tables, hashes = readers.scan_manifest(spark, root)
    assert hashes.count() == 4
    archives = heads.select("archive_id", "generated_at")
    rows = readers.scan_rows(spark, root, "evidence")
    blobs = readers.scan_blobs(spark, root)
    again = aggregates.archive_manifest(rows, blobs, archives, "1")
    diff = sets.manifest_diff(heads, tables, again, aggregates.table_manifest(rows, archives).filter("table = 'evidence'"))
    got = {(r.archive_id, r.field, r.recomputed) for r in diff.collect() if not r.field.endswith("digest")}
    assert got == {("one", "tables.evidence.row_count", "3"), ("two", "tables.evidence.row_count", "5")}
    assert {r.blobs_root for r in again.collect()} == {sha(canon(sorted(H[:2])))}


def test_artifact_rules(spark):
    schema = schemas.ARTIFACTS["workspace"][0]
    good = spark.createDataFrame([("x", *[WORKSPACE[f.name] for f in schema.fields])], "archive_id string, " + ddl(schema))
    rules = lambda df: sorted(r.rule for r in filters.validate_artifacts(df, "workspace").collect())
    assert rules(good) == []
    assert rules(good.withColumn("references", F.reverse("references"))) == ["references_sorted"]
    assert rules(good.withColumn("references", F.array_sort(F.concat("references", "references")))) == ["references_unique"]
    assert rules(good.withColumn("workspace_id", F.lit("a b"))) == ["id_format"]
    event = ("evidence", H[0], H[0], "2026-01-01T00:00:00Z", "evidence.ingested_at")
    later = ("evidence", H[1], H[1], "2026-01-02T00:00:00Z", "evidence.ingested_at")
    line = spark.createDataFrame([("x", "t", "1" * 64, [event, later], event[3], later[3], 2, "2" * 64, "1")],
                                 "archive_id string, " + ddl(schemas.ARTIFACTS["timeline"][0]))
    check = lambda df: sorted(r.rule for r in filters.validate_artifacts(df, "timeline").collect())
    assert check(line) == []
    assert check(line.withColumn("ordered_events", F.reverse("ordered_events"))) == [
        "events_sorted", "first_timestamp_agrees", "last_timestamp_agrees"]
    assert check(line.withColumn("event_count", F.lit(3)).withColumn("last_timestamp", F.lit(None).cast("string"))) == [
        "event_count_agrees", "last_timestamp_agrees"]


def test_built_artifacts_equal_their_landed_form(spark):
    heads = spark.createDataFrame([("x", "w", 'T "q"', "1" * 64), ("x", "dup", "T", "1" * 64), ("x", "none", "T", "1" * 64)],
                                  "archive_id string, workspace_id string, title string, source_manifest_hash string")
    asm_id = f"{H[0]}__manual_research"
    refs = spark.createDataFrame([("x", "w", "evidence", H[1]), ("x", "w", "evidence", H[0]), ("x", "w", "assessment", asm_id),
                                  ("x", "w", "context_bundle", "b"), ("x", "dup", "evidence", H[0]), ("x", "dup", "evidence", H[0])],
                                 "archive_id string, workspace_id string, reference_type string, identifier string")
    built, hashed = artifacts.build_workspace(heads, refs)
    rows = {r.workspace_id: r for r in built.collect()}
    assert set(rows) == {"w", "none"}
    want = sorted([["assessment", asm_id], ["evidence", H[0]], ["evidence", H[1]], ["context_bundle", "b"]])
    record = {"workspace_id": "w", "title": 'T "q"', "source_manifest_hash": "1" * 64, "schema_version": "1",
              "references": [{"reference_type": t, "identifier": i, "artifact_hash": sha(f"{t}:{i}")} for t, i in want]}
    assert rows["w"].workspace_hash == sha(canon(record)) and rows["w"].reference_count == 4
    ev = spark.createDataFrame([("x", H[0], "2026-01-01 00:00:00"), ("x", H[1], "2026-01-01 00:00:00")],
                               "archive_id string, hash string, t string").withColumn("ingested_at", F.to_timestamp("t"))
    asm = spark.createDataFrame([("x", asm_id, "2025-01-01 00:00:00")], "archive_id string, assessment_id string, t string"
                                ).withColumn("created_at", F.to_timestamp("t"))
    lines, events = artifacts.build_timeline(built.withColumn("timeline_id", F.concat("workspace_id", F.lit("t"))), hashed, ev, asm)
    got = {r.timeline_id: r for r in lines.collect()}
    es = [{"artifact_type": "assessment", "artifact_identifier": asm_id, "artifact_hash": sha(asm_id),
           "observed_at": "2025-01-01T00:00:00Z", "source_reference": "assessment.created_at"}]
    es += [{"artifact_type": "evidence", "artifact_identifier": h, "artifact_hash": h, "observed_at": "2026-01-01T00:00:00Z",
            "source_reference": "evidence.ingested_at"} for h in sorted(H[:2])]
    record = {"timeline_id": "wt", "workspace_hash": rows["w"].workspace_hash, "ordered_events": es, "event_count": 3,
              "first_timestamp": es[0]["observed_at"], "last_timestamp": es[-1]["observed_at"], "schema_version": "1"}
    assert got["wt"].timeline_hash == sha(canon(record))
    empty = {"timeline_id": "nonet", "workspace_hash": rows["none"].workspace_hash, "ordered_events": [], "event_count": 0,
             "first_timestamp": None, "last_timestamp": None, "schema_version": "1"}
    assert got["nonet"].timeline_hash == sha(canon(empty))
    assert events.count() == 3


def batch(spark, rows):
    return spark.createDataFrame(rows, (
        "archive_id string, arrival long, path string, hash string, size_bytes long, source_id string, ingested_by string, "
        "t string, source_name string, source_kind string, source_authority string, certificate_hash string")
    ).withColumn("ingested_at", F.to_timestamp("t"))


def test_ingest(spark):
    new = ("N", "news_outlet", "primary")
    at = "2026-02-03 04:05:06"
    cert = CERTIFICATE["certificate_hash"]
    rows = batch(spark, [
        ("x", 1, "a.txt", H[0], 5, "s1", "op", at, *new, cert),            # creates s1, with certificate
        ("x", 2, "b.txt", H[1], 5, "s2", "op", at, None, None, None, None),  # s2 unknown
        ("x", 3, "c.pdf", H[2], 7, "s1", "op", at, "Other", None, None, None),  # contradicts
        ("x", 4, "d.png", H[3], 9, "s1", "op2", at, None, None, None, None),  # fine
        ("x", 5, "e.png", H[3], 9, "s1", "op3", at, None, None, None, None),  # copy
        ("x", 6, "f.png", H[2], 9, "s1", "op3", at, None, None, None, cert),  # certificate of another blob
        ("x", 7, "g.md", sha("old"), 1, "s1", "op", at, None, None, None, None)])  # known already
    known = spark.createDataFrame([("x", sha("old"))], "archive_id string, hash string")
    stored = spark.createDataFrame([], "archive_id string, id string, kind string, name string, authority string, "
                                       "jurisdiction string, license string")
    certs = spark.createDataFrame([("x", *[CERTIFICATE[f.name] for f in schemas.CERTIFICATE.fields])],
                                  "archive_id string, " + ddl(schemas.CERTIFICATE))
    out = ingest.ingest(rows, known, stored, None, certs)
    assert {(r.hash, r.kind, r.ingested_by) for r in out.evidence.collect()} == {
        (H[0], "document_text", "op"), (H[3], "still_image", "op2")}
    assert {(r.arrival, r.reason) for r in out.rejected.collect()} == {
        (2, "source_unknown"), (3, "source_contradicted"), (6, "certificate_other_blob")}
    assert [r.id for r in out.sources.collect()] == ["s1"]
    steps = {r.evidence_hash: r for r in out.provenance.collect()}
    assert steps[H[0]].steps[0].parameters == {
        "capture_certificate_hash": cert, "public_key_fingerprint": "2" * 64, "signature_algorithm": "ed25519", "device_id": "d"}
    assert steps[H[0]].gaps[0].description == ingest.CAPTURED_GAP and steps[H[3]].gaps[0].description == ingest.PLAIN_GAP
    assert {r.row_id for r in out.provenance_steps.collect()} == {f"{H[0]}__step00001", f"{H[3]}__step00001"}
    log = sorted(out.audit.collect(), key=lambda r: r.seq)
    assert [r.action for r in log] == ["archive_bootstrap", "ingest_evidence", "ingest_evidence"]
    assert log[1].parameters == {"size_bytes": "5", "capture_certificate_hash": cert}
    assert log[2].target == f"prov:evidence/sha256:{H[3]}" and log[2].timestamp == "2026-02-03T04:05:06Z"
    assert chains.verify_chain(out.audit).first().ok
    more = ingest.record_derived(out.audit, spark.createDataFrame(
        [("x", "build_workspace", "w", "1" * 64, "op", at), ("x", "ingest_evidence", "no", "1" * 64, "op", at)],
        "archive_id string, action string, artifact_id string, self_hash string, actor string, t string")
        .withColumn("recorded_at", F.to_timestamp("t")), ["artifact_id"])
    assert [(r.seq, r.target) for r in more.collect()] == [(3, "prov:workspace/w")]
    assert chains.verify_chain(out.audit.unionByName(more)).first().ok
    index = spark.createDataFrame([("x", "workspace", "w", "2" * 64), ("x", "timeline", "t", "3" * 64)],
                                  "archive_id string, artifact_kind string, artifact_id string, self_hash string")
    issues = verify.reconcile(index, out.audit.unionByName(more)).collect()
    assert {(r.artifact_id, r.issue_kind) for r in issues} == {
        ("w", "audit_log_hash_mismatch"), ("t", "missing_audit_entry")}


def test_ingest_goes_row_by_row(spark):
    new, at, cert = ("N", "news_outlet", "primary"), "2026-02-03 04:05:06", "e" * 64
    none = (None, None, None)
    rows = batch(spark, [
        ("x", 1, "a", H[0], 5, "s1", "op", at, *new, None),            # creates s1
        ("x", 2, "a", H[0], 5, "s1", "op", at, "Other", *none[1:], None),  # copy of accepted content: left alone
        ("x", 3, "a", H[0], 5, "s2", "op", at, *new, None),            # so is this one; it creates nothing
        ("x", 4, "b", H[1], 5, "s2", "op", at, *none, None),           # s2 is still unknown
        ("x", 5, "c", H[2], 5, "s9", "op", at, *new, cert),            # certificate missing: creates nothing
        ("x", 6, "d", H[3], 5, "s9", "op", at, *none, None),           # unknown
        ("x", 7, "e", H[1], 5, "s2", "op", at, *new, None),            # creates s2
        ("x", 8, "e", H[1], 5, "s3", "op", at, *new, None),            # copy: s3 is not created here
        ("x", 9, "f", H[3], 5, "s3", "op", at, "Name", *new[1:], None),   # but here
        ("x", 10, "g", H[0], 5, "s1", "op", at, *none, cert)])         # a bad certificate is refused for known content too
    stored = spark.createDataFrame([], "archive_id string, id string, kind string, name string, authority string, "
                                       "jurisdiction string, license string")
    certs = spark.createDataFrame([], "archive_id string, " + ddl(schemas.CERTIFICATE))
    out = ingest.ingest(rows, spark.createDataFrame([], "archive_id string, hash string"), stored, None, certs)
    assert {(r.hash, r.source_id) for r in out.evidence.collect()} == {(H[0], "s1"), (H[1], "s2"), (H[3], "s3")}
    assert {(r.arrival, r.reason) for r in out.rejected.collect()} == {
        (4, "source_unknown"), (5, "certificate_missing"), (6, "source_unknown"), (10, "certificate_missing")}
    assert {(r.id, r.name) for r in out.sources.collect()} == {("s1", "N"), ("s2", "N"), ("s3", "Name")}


def test_upsert(spark):
    schema = "archive_id string, row_id string, row_hash string, v string"
    stored = spark.createDataFrame([("x", "a", "h1", "old"), ("x", "b", "h2", "old")], schema)
    new = spark.createDataFrame([("x", "a", "h1", "new", 1), ("x", "b", "h3", "new", 1), ("x", "b", "h4", "last", 2),
                                 ("x", "c", "h5", "new", 1)], schema + ", o int")
    out = {(r.row_id, r.row_hash, r.v) for r in writers.upsert(stored, new, ["archive_id", "row_id"], ["o"]).collect()}
    assert out == {("a", "h1", "old"), ("b", "h4", "last"), ("c", "h5", "new")}


def test_coverage_with_counts_out_of_order(spark):
    entries = spark.createDataFrame([("x", sha(str(i)), i) for i in range(6)], "archive_id string, hash string, seq long")
    counts = [(0, 2), (1, 5), (2, 4), (3, 5)]
    manifests = spark.createDataFrame(
        [("x", s, n, f"m{s}", f"t{s}", "o", "h", "k") for s, n in counts],
        "archive_id string, sequence long, audit_entry_count long, manifest_hash string, signed_at string, operator_id string, "
        "audit_chain_head_hash string, public_key_fingerprint string")
    got = {r.seq: (r.covering_manifests, r.first_sequence) for r in joins.coverage(entries, manifests).collect()}
    for seq in range(6):
        cover = [s for s, n in counts if n > seq]
        assert got[seq] == (len(cover), min(cover) if cover else None)
    least = {r.seq: r.least_count for r in joins.coverage(entries, manifests).collect()}
    assert all(least[i] == min((n for _, n in counts if n > i), default=None) for i in range(6))
    some = [(r.archive_id, r.hash) for r in entries.filter("seq < 4").collect()]
    pairs = {(r.seq, r.sequence) for r in joins.covering_manifests(entries, manifests, some).collect()}
    assert pairs == {(i, s) for i in range(4) for s, n in counts if n > i}


def test_compare_archives_certificates(spark):
    frame = lambda rows: spark.createDataFrame(rows, "hash string, parameters map<string,string>")
    certs = lambda rows: spark.createDataFrame(rows, "evidence_sha256 string, certificate_hash string")
    a = frame([("h1", {"size_bytes": "1"}), ("h2", {"size_bytes": "1"}), ("h3", {}), ("h4", {"size_bytes": "1"})])
    b = frame([("h1", {"size_bytes": "1", "note": "n"}), ("h2", {"size_bytes": "2"}), ("h3", {}), ("h5", {})])
    out = {r.hash: r for r in sets.compare_archives(a, b, None, certs([("h1", "c1"), ("h3", "c3")]),
                                                    certs([("h1", "c9"), ("H3", "c3")])).collect()}
    assert (out["h1"].parameters_match, out["h1"].certificate_match, out["h1"].has_divergence) == (True, False, True)
    assert (out["h2"].diverging_fields, out["h2"].has_divergence) == ("size_bytes", True)
    assert (out["h3"].certificate_match, out["h3"].has_divergence) == (True, False)
    assert {h: r.presence for h, r in out.items() if r.presence != "shared"} == {"h4": "a_only", "h5": "b_only"}


def test_media_chain_faults(spark):
    rows = [("x", e, label, parent, ok, decl) for e, items in {
        "two_roots": [("a", None, True, "two_roots"), ("b", None, True, "two_roots")],
        "twice": [("a", None, True, None), ("b", "a", True, "twice"), ("b", "a", True, "twice")],
        "lost": [("a", None, True, None), ("b", "z", True, "lost")],
        "unsigned": [("a", None, False, "unsigned")],
        "leaves": [("a", None, True, None), ("b", "a", True, "leaves"), ("c", "a", True, "leaves")],
        "unbound": [("a", None, True, None)],
        "other": [("a", None, True, "zz")],
        "fine": [("a", None, True, "FINE")]}.items() for label, parent, ok, decl in items]
    df = spark.createDataFrame(rows, "archive_id string, evidence_sha256 string, label string, parent_label string, "
                                     "signature_verified boolean, declared_sha256 string")
    got = {r.evidence_sha256: r.failure_reason for r in media.media_chain_status(df).collect()}
    assert got == {"two_roots": "expected one root, found 2", "twice": "duplicate labels", "lost": "unknown parent",
                   "unsigned": "signature did not verify", "leaves": "expected one leaf, found 2",
                   "unbound": "leaf has no hash assertion", "other": "leaf hash differs", "fine": None}


def test_streams(spark, tmp_path):
    src, out, state, failures = (str(tmp_path / n) for n in ("in", "out", "state", "failures"))
    schema = ("archive_id string, pos long, seq long, prev_hash string, timestamp string, actor string, action string, "
              "target string, parameters map<string,string>, result string, schema_version string, entry_hash string")
    names = [x.split()[0] for x in schema.split(", ")]
    rows = chain("a", 9)
    rows[4] = {**rows[4], "prev_hash": "f" * 64}
    rows[7] = {**rows[7], "actor": "someone"}
    for i, part in enumerate((rows[:4] + chain("b", 2), rows[4:7], rows[7:] + chain("b", 4)[2:] + chain("c", 1))):
        spark.createDataFrame([tuple(r[n] for n in names) for r in part], schema).coalesce(1).write.mode("append").parquet(src)
        os.utime(sorted(pathlib.Path(src).glob("*.parquet"), key=os.path.getmtime)[-1], (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    run = stream.writeStream.foreachBatch(streams.follow_chain(state, failures)).option(
        "checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination()
    bad = spark.read.parquet(failures).collect()
    assert sorted((r.archive_id, r.seq, r.reason.split(" ")[0]) for r in bad) == [
        ("a", 4, "prev_hash"), ("a", 4 + 3, "entry_hash")]
    blobs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).select(
        F.lit("x").alias("archive_id"), F.sha2("target", 256).alias("hash"), F.to_timestamp("timestamp").alias("arrived_at"))
    run = streams.stream_ingest(blobs).writeStream.foreachBatch(streams.upsert_new(out)).option(
        "checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination()
    held = spark.read.parquet(out)
    assert held.count() == held.select("hash").distinct().count() == 9
    counts = streams.stream_action_counts(stream.withColumn("timestamp", F.to_timestamp("timestamp")))
    run = counts.writeStream.format("memory").queryName("actions").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r.action, r["count"]) for r in spark.table("actions").collect()] == [("ingest_evidence", 14)]


def test_trust_timeline_order(spark):
    ev = spark.createDataFrame([("x", H[0])], "archive_id string, hash string")
    log = spark.createDataFrame([tuple(r.values()) for r in [{**chain("x", 1)[0], "target": f"zz:evidence/sha256:{H[0]}"}]],
                                "archive_id string, pos long, seq long, prev_hash string, timestamp string, actor string, "
                                "action string, target string, parameters map<string,string>, result string, "
                                "schema_version string, entry_hash string")
    manifests = spark.createDataFrame([("x", 0, 1, "m", "2027-01-01T00:00:00Z", "o", "h")],
                                      "archive_id string, sequence long, audit_entry_count long, manifest_hash string, "
                                      "signed_at string, operator_id string, audit_chain_head_hash string")
    prov = spark.createDataFrame([("x", H[0], [{"parameters": {"k": "v"}}, {"parameters": {
        "capture_certificate_hash": CERTIFICATE["certificate_hash"]}}])],
        "archive_id string, evidence_hash string, steps array<struct<parameters:map<string,string>>>")
    certs = spark.createDataFrame([("x", *[CERTIFICATE[f.name] for f in schemas.CERTIFICATE.fields])],
                                  "archive_id string, " + ddl(schemas.CERTIFICATE))
    pr = proofs.Proofs(
        spark.createDataFrame([("x", "p", "t", "ph", "j", "jh", "c")], "archive_id string, proof_id string, proof_type string, "
                              "proof_hash string, target_justification_id string, target_justification_hash string, "
                              "conclusion_claim_id string"),
        None, spark.createDataFrame([("x", "p", 1, "b", H[0]), ("x", "p", 0, "a", H[0])],
                                    "archive_id string, proof_id string, position int, claim_id string, evidence_hash string"),
        spark.createDataFrame([("x", "p", "i", "modus_ponens", "c")],
                              "archive_id string, proof_id string, inference_id string, rule string, output_id string"), None, None)
    assert proofs.proof_references(pr).first().matched_premise_id == "a"
    out = report.trust_timeline(ev, prov, log, manifests, pr, certs).collect()
    assert [r.kind for r in out] == ["capture", "ingest", "manifest", "proof"]
    assert out[-1].timestamp is None


def test_scans_keep_every_file(spark, tmp_path):
    from provlens import schemas
    from provlens.sources import readers, writers
    root = tmp_path / "x" / "data" / "y" / "data"  # its last name recurs in the path
    for archive in ("one", "two"):
        (root / archive / "workspaces").mkdir(parents=True)
        (root / archive / "transparency").mkdir()
    (root / "one" / "workspaces" / "_draft.json").write_text("{}")
    (root / "one" / "workspaces" / "empty.json").write_text("")
    (root / "two" / "workspaces" / ".hid.json").write_text("{}")
    for n in (5, 1000000):
        (root / "two" / "transparency" / f"manifest-{n:06d}.json").write_text(f'{{"sequence": {n}}}')
    got = {(r.archive_id, r.artifact_name, r.decode_error) for r in readers.scan_artifacts(spark, str(root), "workspace").collect()}
    assert got == {("one", "_draft", "hidden_file"), ("one", "empty", "ValueError"), ("two", ".hid", "hidden_file")}
    assert {(r.archive_id, r.sequence) for r in readers.scan_transparency(spark, str(root)).collect()} == {("two", 5), ("two", 1000000)}
    names = [f.name for f in schemas.TRANSPARENCY.fields]
    manifests = spark.createDataFrame([("a", *[1234567 if n == "sequence" else None for n in names])],
                                      "archive_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.TRANSPARENCY.fields))
    witnesses = spark.createDataFrame([], "archive_id string, target_manifest_sequence long")
    assert writers.export_log_index(manifests, witnesses).first().filename == "manifest-1234567.json"
