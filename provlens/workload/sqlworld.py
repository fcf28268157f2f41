"""The world of :mod:`provlens.workload.world` as SQL, written on its own.

``with_world`` puts the needed definitions in front of a query, so each oracle is
one self-contained statement over the given tables.
"""

from __future__ import annotations

import re

from provlens.functions.identifiers import RATIONALES

ZERO = "0" * 64


def s(expr: str) -> str:
    return f"'\"' || {expr} || '\"'"


def sn(expr: str) -> str:
    return f"coalesce('\"' || {expr} || '\"', 'null')"


def n(expr: str) -> str:
    return f"cast({expr} AS varchar)"


def q(text: str) -> str:
    return "'\"" + text.replace("'", "''") + "\"'"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def obj(fields: dict[str, str]) -> str:
    """SQL for canonical JSON of an object whose values are SQL for JSON text."""
    parts = []
    for i, k in enumerate(sorted(fields)):
        parts += [lit(("," if i else "{") + f'"{k}":'), f"({fields[k]})"]
    return "(" + " || ".join([*parts, "'}'"]) + ")"


def arr(expr: str, order: str) -> str:
    """SQL aggregate for a JSON array of JSON texts."""
    return f"('[' || coalesce(string_agg({expr}, ',' ORDER BY {order}), '') || ']')"


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%SZ')"


_KIND = """CASE WHEN n_chars < 400 THEN 'document_text' WHEN n_chars < 1200 THEN 'document_scan'
 WHEN n_chars < 3000 THEN 'still_image' ELSE 'audio_recording' END"""
_MIME = """CASE WHEN n_chars < 400 THEN 'text/plain' WHEN n_chars < 1200 THEN 'application/pdf'
 WHEN n_chars < 3000 THEN 'image/png' ELSE 'audio/wav' END"""
_RATIONALE = "CASE status " + " ".join(
    f"WHEN '{k}' THEN {lit(v)}" for k, v in RATIONALES.items()) + " END"
_URI = "'objects/sha256/' || substr(hash, 1, 2) || '/' || substr(hash, 3)"

CERT = {
    "certificate_type": q("prov.capture.certificate.v1"), "schema_version": q("1"),
    "evidence_sha256": s("hash"), "operator_id": s("source_id"), "captured_at": s("captured_at"),
    "device_id": sn("device_id"), "location": "'null'", "notes": "'null'",
    "public_key_fingerprint": s("public_key_fingerprint"), "signature": s("signature"),
    "signature_algorithm": q("ed25519"),
}
WITNESS = {
    "attestation_type": q("prov.transparency.witness.v1"), "schema_version": q("1"),
    "witness_operator_id": s("source_id"), "witness_public_key_fingerprint": s("sha256('key:' || source_id)"),
    "target_manifest_hash": s("target_manifest_hash"), "target_manifest_sequence": n("sequence"),
    "target_operator_id": s("target_operator_id"), "witnessed_at": s("signed_at"), "statement": "'null'",
    "signature": s("signature"), "signature_algorithm": q("ed25519"),
}
EVIDENCE_PAYLOAD = {
    "hash": s("hash"), "kind": s("kind"), "content_uri": s("content_uri"), "size_bytes": n("size_bytes"),
    "mime_type": s("mime_type"), "source_id": s("source_id"), "status": q("active"),
    "authentication": obj({"status": q("unverified"), "assessor": "'null'", "assessed_at": "'null'",
                           "method": "'null'", "notes": "'null'"}),
    "ingested_at": s(iso("ingested_at")), "ingested_by": s("ingested_by"), "schema_version": q("0.1.0"),
    "notes": "'null'", "intrinsic_metadata": "'{}'",
}
SOURCE_PAYLOAD = {
    "id": s("id"), "kind": q("news_outlet"), "name": s("name"), "authority": q("primary"),
    "jurisdiction": s("jurisdiction"), "license": "'null'", "first_seen": "'null'", "notes": "'null'",
}
ASSESSMENT_PAYLOAD = {
    "assessment_id": s("assessment_id"), "evidence_id": s("evidence_id"), "created_at": s("created_at"),
    "method": q("provenance_review"), "status": s("status"), "rationale": s("rationale"),
    "supporting_source_ids": "CASE WHEN supporting IS NULL THEN '[]' ELSE '[\"' || supporting || '\"]' END",
    "schema_version": q("0.1.0"),
}


def _step(number: int, kind: str, parameters: str) -> str:
    return obj({"step_id": f"'{number}'", "kind": q(kind), "actor": "'null'", "timestamp": "'null'",
                "inputs": "'[]'", "outputs": "'[]'", "parameters": parameters, "notes": "'null'"})


STEP_1 = _step(1, "original_capture", obj({"capture_certificate_hash": s("certificate_hash")}))
STEP_2 = _step(2, "transcription", "'{}'")
PROVENANCE_PAYLOAD = {
    "evidence_hash": s("hash"), "origin_source_id": s("origin_source_id"),
    "steps": f"CASE n_steps WHEN 2 THEN '[' || {STEP_1} || ',' || {STEP_2} || ']' "
             f"WHEN 1 THEN '[' || {STEP_1} || ']' ELSE '[]' END",
    "is_complete": "'false'", "gaps": "'[{\"description\":\"no record before ingest\"}]'",
    "attestor": s("ingested_by"), "attested_at": s(iso("ingested_at")),
}

_EVENT_HEAD = {"action": s("event_type"), "actor": s("archive_id"), "parameters": obj({"cents": s("cents")})}
_EVENT_TAIL = {"result": q("success"), "schema_version": q("0.1.0"), "seq": n("pos"),
               "target": s("'prov:event/' || event_id"), "timestamp": s("timestamp")}


def entry_text(prev: str, cents: str = "cents", seq: str = "pos") -> str:
    head = {**_EVENT_HEAD, "parameters": obj({"cents": s(cents)})}
    tail = {**_EVENT_TAIL, "seq": n(seq)}
    return obj({**head, **tail, "prev_hash": s(prev)})


_MANIFEST = {
    "sequence": n("sequence"), "signed_at": s("signed_at"), "manifest_type": q("prov.transparency.manifest.v1"),
    "operator_id": s("operator_id"), "public_key_fingerprint": s("public_key_fingerprint"),
    "archive_manifest_hash": s("archive_manifest_hash"), "audit_chain_head_hash": s("audit_chain_head_hash"),
    "audit_entry_count": n("audit_entry_count"), "evidence_count": n("audit_entry_count"),
    **{f"{k}_count": "'0'" for k in ("attestation", "workspace", "timeline", "snapshot", "justification")},
    "signature": s("signature"), "signature_algorithm": q("ed25519"), "schema_version": q("1"),
}


def manifest_text(prev: str, signature: str = "signature") -> str:
    return obj({**_MANIFEST, "previous_manifest_hash": s(prev), "signature": s(signature)})


_ENTRY = lambda role, name: obj({
    "entry_hash": s(f"sha256('{role}:' || {name})"), "entry_identifier": s(name), "entry_role": q(role)})


WORLD = {
    "docs": """SELECT lang AS archive_id, sha256(text) AS hash, doc_id, source AS source_id,
 octet_length(encode(text)) AS size_bytes, n_chars, source || '/' || doc_id || CASE WHEN n_chars < 400 THEN '.txt'
 WHEN n_chars < 1200 THEN '.PDF' WHEN n_chars < 3000 THEN '.png' ELSE '.wav' END AS path,
 TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ingested_at FROM documents""",
    "ev": f"""SELECT * EXCLUDE (rn), {_KIND} AS kind, {_MIME} AS mime_type, {_URI} AS content_uri,
 'op-' || source_id AS ingested_by FROM (SELECT *, row_number() OVER (PARTITION BY archive_id, hash
 ORDER BY doc_id) AS rn FROM docs) x WHERE rn = 1""",
    "lab": "SELECT ev.*, quality, toxic FROM ev LEFT JOIN labels USING (doc_id)",
    "src": """SELECT DISTINCT archive_id, source_id AS id, 'Source ' || source_id AS name,
 upper(archive_id) AS jurisdiction FROM docs WHERE source_id NOT IN ('src7', 'src19')""",
    "cert0": f"""SELECT archive_id, hash, source_id, toxic, {iso("ingested_at - INTERVAL 1 DAY")} AS captured_at,
 CASE WHEN n_chars <= 2000 THEN 'cam-' || archive_id END AS device_id,
 sha256('key:' || source_id) AS public_key_fingerprint,
 sha256('a:' || hash) || sha256('b:' || hash) AS signature FROM lab WHERE quality = 1""",
    "cert": f"SELECT *, sha256({obj(CERT)}) AS certificate_hash FROM cert0",
    "prov": """SELECT lab.*, CASE WHEN toxic = 1 THEN 'ghost' ELSE lab.source_id END AS origin_source_id,
 CASE WHEN quality = 1 AND n_chars > 2000 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS n_steps, certificate_hash
 FROM lab LEFT JOIN (SELECT archive_id, hash, certificate_hash FROM cert) c USING (archive_id, hash)
 WHERE n_chars >= 400""",
    "asm0": f"""SELECT ev.archive_id, ev.hash AS evidence_id, ev.hash || '__provenance_review' AS assessment_id,
 {iso("ev.ingested_at + INTERVAL 1 HOUR")} AS created_at, ev.source_id, s.id AS supporting,
 CASE WHEN p.hash IS NOT NULL AND o.id IS NULL THEN 'contradicted' WHEN s.id IS NULL THEN 'unverified'
 WHEN coalesce(p.n_steps, 0) = 0 THEN 'partially_supported' ELSE 'supported' END AS status
 FROM ev LEFT JOIN prov p ON p.archive_id = ev.archive_id AND p.hash = ev.hash
 LEFT JOIN src s ON s.archive_id = ev.archive_id AND s.id = ev.source_id
 LEFT JOIN src o ON o.archive_id = ev.archive_id AND o.id = p.origin_source_id""",
    "asm": f"SELECT *, {_RATIONALE} AS rationale FROM asm0",
    "arch": "SELECT DISTINCT archive_id FROM docs",
    "ilog": f"""SELECT ev.archive_id, row_number() OVER (PARTITION BY ev.archive_id ORDER BY ev.doc_id) - 1 AS seq,
 ev.hash, ev.size_bytes, {iso("ev.ingested_at")} AS timestamp, ev.ingested_by AS actor,
 sha256('entry:' || ev.hash) AS entry_hash, c.certificate_hash FROM ev
 LEFT JOIN cert c ON c.archive_id = ev.archive_id AND c.hash = ev.hash""",
    "ebase": f"""SELECT 'u' || user_id AS archive_id, row_number() OVER (PARTITION BY user_id
 ORDER BY ts, event_id) - 1 AS pos, event_type, event_id, ts, cast(cast(round(value * 100) AS bigint) AS varchar)
 AS cents, {iso("ts")} AS timestamp FROM events""",
    "echain": f"""SELECT archive_id, pos, '{ZERO}' AS prev_hash, sha256({entry_text(lit(ZERO))}) AS entry_hash
 FROM ebase WHERE pos = 0 UNION ALL SELECT archive_id, pos, last_hash, sha256({entry_text("last_hash")})
 FROM (SELECT b.*, c.entry_hash AS last_hash FROM echain c JOIN ebase b
 ON b.archive_id = c.archive_id AND b.pos = c.pos + 1) x""",
    "elog": "SELECT b.*, b.pos AS seq, c.prev_hash, c.entry_hash FROM ebase b JOIN echain c USING (archive_id, pos)",
    "tlog": """SELECT archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY seq) - 1 AS pos, seq, event_type,
 event_id, ts, timestamp, prev_hash, entry_hash, CASE WHEN cast(cents AS bigint) >= 20000
 THEN cast(cast(cents AS bigint) + 1 AS varchar) ELSE cents END AS cents FROM elog WHERE cast(cents AS bigint) > 3""",
    "tlink": f"""SELECT *, sha256({entry_text("prev_hash", "cents", "seq")}) AS computed_hash,
 coalesce(lag(seq) OVER w + 1, 0) AS expected_seq, coalesce(lag(entry_hash) OVER w, '{ZERO}') AS expected_prev_hash
 FROM tlog WINDOW w AS (PARTITION BY archive_id ORDER BY pos)""",
    "hours": """SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY hour) - 1 AS sequence FROM (
 SELECT archive_id, hour, cast(sum(n) OVER (PARTITION BY archive_id ORDER BY hour) AS bigint) AS audit_entry_count
 FROM (SELECT archive_id, doc_id // 60 AS hour, count(*) AS n FROM ev GROUP BY 1, 2) x) y""",
    "man": f"""SELECT archive_id, hour, sequence, audit_entry_count,
 {iso("TIMESTAMP '2024-01-01' + to_hours(cast(hour + 1 AS bigint))")} AS signed_at,
 'operator-' || archive_id AS operator_id, sha256('key:operator-' || archive_id) AS public_key_fingerprint,
 sha256('am:' || archive_id || ':' || sequence) AS archive_manifest_hash,
 sha256('head:' || archive_id || ':' || sequence) AS audit_chain_head_hash,
 CASE WHEN sequence = 0 THEN '{ZERO}' ELSE sha256('m:' || archive_id || ':' || (sequence - 1)) END
 AS previous_manifest_hash,
 sha256('a:' || archive_id || ':' || sequence) || sha256('b:' || archive_id || ':' || sequence) AS signature,
 sha256('m:' || archive_id || ':' || sequence) AS manifest_hash FROM hours""",
    "mchain": f"""SELECT archive_id, sequence, '{ZERO}' AS prev, sha256({manifest_text(lit(ZERO))}) AS mhash FROM man
 WHERE sequence = 0 UNION ALL SELECT archive_id, sequence, last_hash, sha256({manifest_text("last_hash")})
 FROM (SELECT m.*, c.mhash AS last_hash FROM mchain c JOIN man m
 ON m.archive_id = c.archive_id AND m.sequence = c.sequence + 1) x""",
    "cman": """SELECT m.* EXCLUDE (manifest_hash, previous_manifest_hash, signature),
 CASE WHEN m.archive_id = 'es' AND m.sequence > 3 THEN reverse(m.signature) ELSE m.signature END AS signature,
 c.prev AS previous_manifest_hash, c.mhash AS manifest_hash FROM man m JOIN mchain c USING (archive_id, sequence)""",
    "wit0": """SELECT x.archive_id, x.source_id, m.sequence, m.signed_at, m.manifest_hash, m.operator_id,
 CASE WHEN x.source_id = 'src7' THEN sha256('other') ELSE m.manifest_hash END AS target_manifest_hash,
 CASE WHEN x.source_id = 'src19' THEN 'someone' ELSE m.operator_id END AS target_operator_id,
 sha256('a:' || x.archive_id || ':' || m.sequence || ':' || x.source_id) ||
 sha256('b:' || x.archive_id || ':' || m.sequence || ':' || x.source_id) AS signature
 FROM (SELECT DISTINCT archive_id, doc_id // 60 AS hour, source_id FROM ev) x
 JOIN man m ON m.archive_id = x.archive_id AND m.hour = x.hour""",
    "wit": f"SELECT *, sha256({obj(WITNESS)}) AS attestation_hash FROM wit0",
    "keys": """SELECT DISTINCT sha256('key:' || id) AS public_key_fingerprint FROM src UNION
 SELECT sha256('key:operator-' || archive_id) FROM arch""",
    "wref": """SELECT archive_id, archive_id || '.' || source_id AS workspace_id, 'evidence' AS reference_type,
 hash AS identifier FROM ev UNION ALL SELECT a.archive_id, a.archive_id || '.' || a.source_id, 'assessment',
 a.assessment_id FROM asm a UNION ALL SELECT DISTINCT archive_id, archive_id || '.' || source_id,
 'impact_analysis', 'impact-' || source_id FROM ev""",
    "whash": "SELECT *, sha256(reference_type || ':' || identifier) AS artifact_hash FROM wref",
    "wjson": f"""SELECT archive_id, workspace_id, count(*) AS reference_count, {arr(
        obj({"reference_type": s("reference_type"), "identifier": s("identifier"), "artifact_hash": s("artifact_hash")}),
        "reference_type, identifier, artifact_hash")} AS refs FROM whash GROUP BY 1, 2""",
    "ws": f"""SELECT archive_id, workspace_id, reference_count, refs, 'Case ' || workspace_id AS title,
 sha256({obj({"references": "refs", "schema_version": q("1"), "source_manifest_hash": s("sha256('am:' || archive_id)"),
              "title": s("'Case ' || workspace_id"), "workspace_id": s("workspace_id")})}) AS workspace_hash
 FROM wjson""",
    "tev": f"""SELECT r.archive_id, r.workspace_id || '.t' AS timeline_id, 'evidence' AS artifact_type,
 r.identifier AS artifact_identifier, r.identifier AS artifact_hash, {iso("ev.ingested_at")} AS observed_at,
 'evidence.ingested_at' AS source_reference FROM wref r JOIN ev ON ev.archive_id = r.archive_id
 AND ev.hash = r.identifier WHERE r.reference_type = 'evidence'
 UNION ALL SELECT r.archive_id, r.workspace_id || '.t', 'assessment', r.identifier, sha256(r.identifier),
 a.created_at, 'assessment.created_at' FROM wref r JOIN asm a ON a.archive_id = r.archive_id
 AND a.assessment_id = r.identifier WHERE r.reference_type = 'assessment'""",
    "tjson": f"""SELECT archive_id, timeline_id, count(*) AS event_count, min(observed_at) AS first_timestamp,
 max(observed_at) AS last_timestamp, {arr(obj({c: s(c) for c in (
     "artifact_type", "artifact_identifier", "artifact_hash", "observed_at", "source_reference")}),
     "observed_at, artifact_hash, artifact_type, artifact_identifier")} AS events FROM tev GROUP BY 1, 2""",
    "tl": f"""SELECT t.*, w.workspace_id, w.workspace_hash, w.refs, sha256({obj({
        "event_count": n("event_count"), "first_timestamp": sn("first_timestamp"),
        "last_timestamp": sn("last_timestamp"), "ordered_events": "events", "schema_version": q("1"),
        "timeline_id": s("timeline_id"), "workspace_hash": s("workspace_hash")})}) AS timeline_hash
 FROM tjson t JOIN ws w ON w.archive_id = t.archive_id AND w.workspace_id || '.t' = t.timeline_id""",
    "j0": """SELECT a.archive_id, a.assessment_id, a.evidence_id, a.source_id, a.supporting,
 sha256('am:' || a.archive_id) AS source_manifest_hash, coalesce(p.n_steps, 0) AS n_steps
 FROM asm a LEFT JOIN prov p ON p.archive_id = a.archive_id AND p.hash = a.evidence_id""",
    "just": f"""SELECT *, sha256({obj({
        "justification_id": s("assessment_id"), "conclusion_anchor_type": q("assessment"),
        "conclusion_anchor_id": s("assessment_id"),
        "conclusion_anchor_hash": s("sha256('assessment:' || assessment_id)"),
        "minimal_evidence": f"'[' || {_ENTRY('evidence', 'evidence_id')} || CASE WHEN supporting IS NULL THEN '' "
                            f"ELSE ',' || {_ENTRY('source', 'supporting')} END || ']'",
        "supporting_assessments": f"'[' || {_ENTRY('assessment', 'assessment_id')} || ']'",
        "graph_nodes_used": "'[' || " + _ENTRY("graph_node", "('evidence:' || evidence_id)") + " || ',' || "
                            + _ENTRY("graph_node", "('source:' || source_id)") + " || ']'",
        "intermediate_artifacts": "'[]'",
        "provenance_chain": "CASE n_steps WHEN 0 THEN '[]' ELSE '[' || "
                            + _ENTRY("provenance_step", "(evidence_id || '__step00001')")
                            + " || CASE WHEN n_steps = 2 THEN ',' || "
                            + _ENTRY("provenance_step", "(evidence_id || '__step00002')") + " ELSE '' END || ']' END",
        "workspace_hash": "'null'", "source_manifest_hash": s("source_manifest_hash"),
        "justification_engine_version": q("1.0.0"), "justification_method_name": q("deductive_chain_v1"),
        "schema_version": q("1")})}) AS justification_hash FROM j0""",
    "rows": f"""SELECT archive_id, 'evidence' AS tbl, hash AS row_id, {obj(EVIDENCE_PAYLOAD)} AS payload FROM ev
 UNION ALL SELECT archive_id, 'sources', id, {obj(SOURCE_PAYLOAD)} FROM src
 UNION ALL SELECT archive_id, 'provenance', hash, {obj(PROVENANCE_PAYLOAD)} FROM prov
 UNION ALL SELECT archive_id, 'provenance_steps', hash || '__step00001', {STEP_1} FROM prov WHERE n_steps >= 1
 UNION ALL SELECT archive_id, 'provenance_steps', hash || '__step00002', {STEP_2} FROM prov WHERE n_steps = 2
 UNION ALL SELECT archive_id, 'authentication_assessments', assessment_id, {obj(ASSESSMENT_PAYLOAD)} FROM asm""",
    "rhash": "SELECT archive_id, tbl, row_id, sha256(payload) AS row_hash FROM rows",
    "tables5": """SELECT archive_id, tbl FROM arch, (VALUES ('evidence'), ('sources'), ('provenance'),
 ('provenance_steps'), ('authentication_assessments')) t(tbl)""",
    "tman": f"""SELECT t.archive_id, t.tbl, count(r.row_hash) AS row_count, sha256('schema:' || t.tbl) AS schema_hash,
 {arr("'\"' || r.row_hash || '\"'", "r.row_hash")} AS hashes FROM tables5 t LEFT JOIN rhash r
 ON r.archive_id = t.archive_id AND r.tbl = t.tbl GROUP BY t.archive_id, t.tbl""",
    "broot": f"""SELECT archive_id, sha256({arr("'\"' || hash || '\"'", "hash")}) AS blobs_root FROM ev
 GROUP BY archive_id""",
    "amtab": f"""SELECT archive_id, '{{' || string_agg('"' || tbl || '":' || {obj({
        "partition_hashes": "hashes", "row_count": n("row_count"), "schema_hash": s("schema_hash")})},
 ',' ORDER BY tbl) || '}}' AS tables FROM tman GROUP BY archive_id""",
    "am": f"""SELECT archive_id, blobs_root, sha256({obj({
        "blobs_root": s("blobs_root"), "generated_at": q("2024-01-01T00:00:00Z"), "notes": "'null'",
        "schema_version": q("0.1.0"), "software_version": q("0.1.0"), "tables": "tables"})}) AS manifest_hash
 FROM amtab JOIN broot USING (archive_id)""",
    "nodes": """SELECT archive_id, 'evidence' AS kind, hash AS id FROM ev UNION SELECT archive_id, 'source', id FROM src
 UNION SELECT archive_id, 'assessment', assessment_id FROM asm""",
    "edges": """SELECT archive_id, 'sourced_from' AS kind, 'evidence' AS src_kind, hash AS src_id,
 'source' AS dst_kind, source_id AS dst_id FROM ev UNION SELECT archive_id, 'assessed_from', 'assessment',
 assessment_id, 'evidence', evidence_id FROM asm UNION SELECT archive_id, 'derived_from', 'assessment',
 assessment_id, 'source', supporting FROM asm WHERE supporting IS NOT NULL""",
    "up": """SELECT archive_id, src_kind AS root_kind, src_id AS root_id, dst_kind AS node_kind, dst_id AS node_id,
 min(distance) AS distance FROM (SELECT *, 1 AS distance FROM edges UNION ALL
 SELECT a.archive_id, a.kind, a.src_kind, a.src_id, b.dst_kind, b.dst_id, 2 FROM edges a JOIN edges b
 ON a.archive_id = b.archive_id AND a.dst_kind = b.src_kind AND a.dst_id = b.src_id) x GROUP BY ALL""",
    "trade": """SELECT DISTINCT 'line' AS src_kind, l_orderkey || '-' || l_linenumber AS src_id, 'order' AS dst_kind,
 cast(l_orderkey AS varchar) AS dst_id FROM lineitem UNION ALL
 SELECT 'order', cast(o_orderkey AS varchar), 'customer', cast(o_custkey AS varchar) FROM orders UNION ALL
 SELECT 'customer', cast(c_custkey AS varchar), 'nation', cast(c_nationkey AS varchar) FROM customer UNION ALL
 SELECT 'nation', cast(n_nationkey AS varchar), 'region', cast(n_regionkey AS varchar) FROM nation""",
    "reach": """SELECT src_kind, src_id, dst_kind, dst_id, 1 AS distance FROM trade UNION ALL
 SELECT r.src_kind, r.src_id, t.dst_kind, t.dst_id, r.distance + 1 FROM reach r JOIN trade t
 ON r.dst_kind = t.src_kind AND r.dst_id = t.src_id""",
    "turns": """SELECT 'talk' AS archive_id, cast(conv_id AS varchar) AS proof_id, cast(turn AS int) AS turn, role,
 sha256(text) AS text_hash, max(turn) OVER (PARTITION BY conv_id) AS last,
 last_value(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING
 AND UNBOUNDED FOLLOWING) AS last_role FROM conversations""",
    "psteps": """SELECT archive_id, proof_id, 'i' || turn AS inference_id, 'c' || turn AS output_id,
 CASE role WHEN 'assistant' THEN 'modus_ponens' WHEN 'user' THEN 'abduction_to_best_explanation'
 ELSE 'intuition' END AS rule, turn FROM turns WHERE turn > 0""",
    "pinputs": """SELECT archive_id, proof_id, 'i' || turn AS inference_id, 'c' || (turn - 1) AS claim_id FROM turns
 WHERE turn > 0 UNION ALL SELECT archive_id, proof_id, 'i' || turn, 'c' || (turn - 2) FROM turns
 WHERE turn > 1 AND role = 'assistant' UNION ALL SELECT archive_id, proof_id, 'i1', 'c' || last FROM turns
 WHERE turn = 0 AND last > 0 AND last_role = 'user'""",
    "pedges": """SELECT DISTINCT i.archive_id, i.proof_id, i.claim_id AS source, s.output_id AS target
 FROM pinputs i JOIN psteps s USING (archive_id, proof_id, inference_id)""",
    "preach": """SELECT archive_id, proof_id, source AS origin, target FROM pedges UNION
 SELECT r.archive_id, r.proof_id, r.origin, e.target FROM preach r JOIN pedges e
 ON e.archive_id = r.archive_id AND e.proof_id = r.proof_id AND e.source = r.target""",
    "perrors": """SELECT s.archive_id, s.proof_id, s.inference_id AS subject, CASE
 WHEN s.rule = 'intuition' THEN 'unknown_rule' WHEN s.rule = 'modus_ponens' AND count(i.claim_id) < 2
 THEN 'too_few_inputs' WHEN s.rule = 'modus_ponens' AND count(i.claim_id) > 2 THEN 'too_many_inputs' END AS error
 FROM psteps s LEFT JOIN pinputs i USING (archive_id, proof_id, inference_id)
 GROUP BY s.archive_id, s.proof_id, s.inference_id, s.rule""",
    "cref": """SELECT archive_id, archive_id || '.' || source_id AS proof_id, hash, CASE WHEN quality = 1 THEN 'p0'
 ELSE 'p1' END AS matched_premise_id FROM lab""",
    "pblobs": """SELECT regexp_extract(url, '\\.([a-z]+)/', 1) AS archive_id,
 CASE WHEN contains(url, '//m.') THEN sha256(url) ELSE sha256(html) END AS hash, sha256(html) AS actual FROM pages""",
}


def with_world(sql: str) -> str:
    """Prefix ``sql`` with the definitions it uses, in their order."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in WORLD:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                needed.add(name)
                todo.append(WORLD[name])
    parts = [f"{k} AS ({v})" for k, v in WORLD.items() if k in needed]
    return f"WITH RECURSIVE {', '.join(parts)} {sql}" if parts else sql
