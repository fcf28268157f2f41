"""Archives derived from the given tables.

Documents make evidence in one archive per language; events make one audit log
per user; conversations make proofs; pages make blobs; orders make a deep graph.
Every frame covers its whole table. Faults follow from attributes of the rows.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlens import schemas
from provlens.functions import canonical as canon
from provlens.functions import identifiers as ids
from provlens.functions.canonical import canonical_struct
from provlens.functions.ordered import running, sequenced
from provlens.operators import artifacts, chains, graph, joins
from provlens.operators.proofs import Proofs
from provlens.session import landed

START = 1704067200  # 2024-01-01T00:00:00Z
UNREGISTERED = ["src7", "src19"]


def sha(*parts: str | Column) -> Column:
    return F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


_TABLES: dict[tuple[str, str, str], object] = {}


def kept(fn):
    """A property written once per session and folder, as the archives' own tables would be."""
    name = fn.__name__

    def get(self):
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _TABLES:
            made = fn(self)
            _TABLES[key] = type(made)(*map(landed, made)) if isinstance(made, Proofs) else (
                tuple(map(landed, made)) if isinstance(made, tuple) else landed(made))
        return _TABLES[key]

    return property(get)


class World:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- evidence and what surrounds it ----------------------------------------------------

    @cached_property
    def documents(self) -> DataFrame:
        suffix = (F.when(F.col("n_chars") < 400, ".txt").when(F.col("n_chars") < 1200, ".PDF")
                  .when(F.col("n_chars") < 3000, ".png").otherwise(".wav"))
        return self.table("documents").select(
            F.col("lang").alias("archive_id"), F.sha2("text", 256).alias("hash"), "doc_id",
            F.col("source").alias("source_id"), F.octet_length("text").cast("long").alias("size_bytes"),
            "n_chars", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"),
            F.timestamp_seconds(F.lit(START) + F.col("doc_id") * 60).alias("ingested_at"))

    @kept
    def evidence(self) -> DataFrame:
        first = chains.dedupe_first(self.documents, ["archive_id", "hash"], ["doc_id"])
        kind = ids.infer_kind(F.col("path"), F.lit(None).cast("string"))
        return first.select(
            "archive_id", "hash", "doc_id", "source_id", "size_bytes", "n_chars", "path", "ingested_at",
            kind.alias("kind"), ids.infer_mime(kind).alias("mime_type"),
            ids.object_uri(F.col("hash")).alias("content_uri"),
            F.concat(F.lit("op-"), F.col("source_id")).alias("ingested_by"),
            F.lit("active").alias("status"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
            F.lit(None).cast("string").alias("notes"))

    @kept
    def labelled(self) -> DataFrame:
        return self.evidence.join(self.table("labels"), "doc_id", "left")

    @kept
    def sources(self) -> DataFrame:
        return (self.documents.select("archive_id", F.col("source_id").alias("id")).distinct()
                .filter(~F.col("id").isin(UNREGISTERED))
                .select("archive_id", "id", F.lit("news_outlet").alias("kind"),
                        F.concat(F.lit("Source "), F.col("id")).alias("name"),
                        F.lit("primary").alias("authority"), F.upper("archive_id").alias("jurisdiction"),
                        F.lit(None).cast("string").alias("license")))

    @kept
    def certificates(self) -> DataFrame:
        """One per evidence of good quality; those of toxic ones were edited later."""
        base = self.labelled.filter("quality = 1").select(
            "archive_id", F.lit(f"{schemas.NAMESPACE}.capture.certificate.v1").alias("certificate_type"),
            F.lit("1").alias("schema_version"), F.col("hash").alias("evidence_sha256"),
            F.col("source_id").alias("operator_id"),
            ids.iso_second(F.timestamp_seconds(F.lit(START - 86400) + F.col("doc_id") * 60)).alias("captured_at"),
            F.when(F.col("n_chars") <= 2000, F.concat(F.lit("cam-"), F.col("archive_id"))).alias("device_id"),
            F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("notes"),
            sha("key:", F.col("source_id")).alias("public_key_fingerprint"),
            F.concat(sha("a:", F.col("hash")), sha("b:", F.col("hash"))).alias("signature"),
            F.lit("ed25519").alias("signature_algorithm"), (F.col("toxic") == 1).alias("edited"))
        hashed = base.withColumn("certificate_hash", canon.self_hash(base, "certificate"))
        return hashed.withColumn("notes", F.when(F.col("edited"), F.lit("edited"))).drop("edited")

    @kept
    def provenance(self) -> DataFrame:
        """Absent for short texts; toxic ones name an unknown origin; steps follow quality."""
        step = lambda n, kind, params: F.struct(
            F.lit(n).cast("long").alias("step_id"), F.lit(kind).alias("kind"),
            F.lit(None).cast("string").alias("actor"), F.lit(None).cast("string").alias("timestamp"),
            F.array().cast(schemas.STRINGS).alias("inputs"), F.array().cast(schemas.STRINGS).alias("outputs"),
            params.alias("parameters"), F.lit(None).cast("string").alias("notes"))
        certs = self.certificates.select("archive_id", F.col("evidence_sha256").alias("hash"), "certificate_hash")
        named = F.create_map(F.lit("capture_certificate_hash"), F.col("certificate_hash"))
        empty = F.create_map().cast(schemas.STRING_MAP)
        one = step(1, "original_capture", named)
        two = step(2, "transcription", empty)
        good = F.col("quality") == 1
        steps = (F.when(good & (F.col("n_chars") > 2000), F.array(one, two)).when(good, F.array(one))
                 .otherwise(F.array().cast(schemas.PAYLOADS["provenance"]["steps"].dataType)))
        return (self.labelled.filter("n_chars >= 400").join(certs, ["archive_id", "hash"], "left").select(
            "archive_id", F.col("hash").alias("evidence_hash"),
            F.when(F.col("toxic") == 1, F.lit("ghost")).otherwise(F.col("source_id")).alias("origin_source_id"),
            steps.alias("steps"), F.lit(False).alias("is_complete"),
            F.array(F.struct(F.lit("no record before ingest").alias("description"))).alias("gaps"),
            F.col("ingested_by").alias("attestor"), F.col("ingested_at").alias("attested_at")))

    @kept
    def assessments(self) -> DataFrame:
        return joins.assess(self.evidence, self.sources, self.provenance,
                            F.col("ingested_at") + F.expr("INTERVAL 1 HOUR"))

    @cached_property
    def archives(self) -> DataFrame:
        return self.documents.select("archive_id").distinct().withColumn(
            "generated_at", F.timestamp_seconds(F.lit(START)))

    # --- logs ------------------------------------------------------------------------------

    @kept
    def ingest_log(self) -> DataFrame:
        """Ingest entries per archive in document order; hashes here are stand-ins."""
        certs = self.certificates.select("archive_id", F.col("evidence_sha256").alias("hash"), "certificate_hash")
        rows = self.evidence.join(certs, ["archive_id", "hash"], "left")
        placed = sequenced(rows.select("archive_id", "hash", "doc_id", "size_bytes", "ingested_at", "ingested_by",
                                       "certificate_hash"), ["archive_id"], ["doc_id"])
        size = F.struct(F.lit("size_bytes").alias("key"), F.col("size_bytes").cast("string").alias("value"))
        cert = F.when(F.col("certificate_hash").isNotNull(), F.struct(
            F.lit("capture_certificate_hash").alias("key"), F.col("certificate_hash").alias("value")))
        return placed.select(
            "archive_id", F.col("position").alias("pos"), F.col("position").alias("seq"),
            F.lit(schemas.ZERO_HASH).alias("prev_hash"), ids.iso_second(F.col("ingested_at")).alias("timestamp"),
            F.col("ingested_by").alias("actor"), F.lit("ingest_evidence").alias("action"),
            ids.evidence_uri(F.col("hash")).alias("target"),
            F.map_from_entries(F.array_compact(F.array(size, cert))).alias("parameters"),
            F.lit("success").alias("result"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
            sha("entry:", F.col("hash")).alias("entry_hash"))

    @cached_property
    def events(self) -> DataFrame:
        cents = F.round(F.col("value") * 100).cast("long").cast("string")
        return self.table("events").select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("archive_id"), "ts", "event_id", "value",
            ids.iso_second(F.col("ts")).alias("timestamp"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"),
            F.col("event_type").alias("action"),
            F.concat(F.lit("prov:event/"), F.col("event_id").cast("string")).alias("target"),
            F.create_map(F.lit("cents"), cents).alias("parameters"), F.lit("success").alias("result"),
            F.lit(schemas.SCHEMA_VERSION).alias("schema_version"))

    @kept
    def event_log(self) -> DataFrame:
        """Chained log per user."""
        return chains.append_chain(None, self.events.drop("value"), ["ts", "event_id"])

    @kept
    def tampered_log(self) -> DataFrame:
        """Large amounts changed after the fact, tiny ones deleted."""
        cents = F.element_at("parameters", "cents").cast("long")
        kept = self.event_log.filter(cents > 3)
        placed = sequenced(kept.drop("pos"), ["archive_id"], ["seq"])
        return (placed.withColumn("pos", F.col("position")).drop("position")
                .withColumn("parameters", F.when(cents >= 20000, F.create_map(
                    F.lit("cents"), (cents + 1).cast("string"))).otherwise(F.col("parameters"))))

    # --- transparency ----------------------------------------------------------------------

    @kept
    def _hours(self) -> DataFrame:
        """Hours with ingests per archive and the entries up to their end."""
        counts = self.evidence.groupBy(
            "archive_id", F.floor(F.col("doc_id") / 60).alias("hour")).agg(F.count("*").alias("n"))
        totals = running(counts, ["archive_id"], ["hour"], {"audit_entry_count": ("sum", "n")})
        return sequenced(totals, ["archive_id"], ["hour"]).withColumnRenamed("position", "sequence")

    @cached_property
    def manifests(self) -> DataFrame:
        """Hourly log manifests with stand-in hashes, for the joins."""
        a, seq = F.col("archive_id"), F.col("sequence")
        name = F.concat(a, F.lit(":"), seq.cast("string"))
        zero = F.lit(0).cast("long")
        return self._hours.select(
            "archive_id", seq.cast("long").alias("sequence"),
            ids.iso_second(F.timestamp_seconds(F.lit(START) + (F.col("hour") + 1) * 3600)).alias("signed_at"),
            F.lit(f"{schemas.NAMESPACE}.transparency.manifest.v1").alias("manifest_type"),
            F.concat(F.lit("operator-"), a).alias("operator_id"),
            sha("key:operator-", a).alias("public_key_fingerprint"),
            sha("am:", name).alias("archive_manifest_hash"), sha("head:", name).alias("audit_chain_head_hash"),
            "audit_entry_count", F.col("audit_entry_count").alias("evidence_count"),
            zero.alias("attestation_count"), zero.alias("workspace_count"), zero.alias("timeline_count"),
            zero.alias("snapshot_count"), zero.alias("justification_count"),
            F.when(seq == 0, F.lit(schemas.ZERO_HASH)).otherwise(
                sha("m:", a, ":", (seq - 1).cast("string"))).alias("previous_manifest_hash"),
            F.concat(sha("a:", name), sha("b:", name)).alias("signature"),
            F.lit("ed25519").alias("signature_algorithm"), sha("m:", name).alias("manifest_hash"),
            F.lit("1").alias("schema_version"))

    @kept
    def chained_manifests(self) -> DataFrame:
        """The same log with real hashes and links; Spanish ones were re-signed later."""
        names = [f.name for f in schemas.TRANSPARENCY.fields
                 if f.name not in ("manifest_hash", "previous_manifest_hash")]
        rows = self.manifests.drop("manifest_hash", "previous_manifest_hash")
        fields = {n: (F.col(n), rows.schema[n].dataType) for n in names}
        before = {n: v for n, v in fields.items() if n < "previous_manifest_hash"}
        after = {n: v for n, v in fields.items() if n > "previous_manifest_hash"}
        head, tail = canonical_struct(before), canonical_struct(after)
        linked = chains.fold_chain(rows.select(
            "archive_id", F.col("sequence").alias("position"),
            F.concat(F.substring(head, F.lit(1), F.length(head) - 1),
                     F.lit(',"previous_manifest_hash":"')).alias("left"),
            F.concat(F.lit('",'), F.substring(tail, F.lit(2), F.length(tail))).alias("right")))
        out = rows.join(linked.select("archive_id", F.col("position").alias("sequence"),
                                      F.col("prev_hash").alias("previous_manifest_hash"),
                                      F.col("entry_hash").alias("manifest_hash")), ["archive_id", "sequence"])
        changed = (F.col("archive_id") == "es") & (F.col("sequence") > 3)
        return out.withColumn("signature", F.when(changed, F.reverse("signature")).otherwise(F.col("signature")))

    @kept
    def witnesses(self) -> DataFrame:
        """Each source with an ingest in the hour is a witness; two of them err."""
        hours = self._hours.select("archive_id", "hour", "sequence")
        seen = self.evidence.select("archive_id", F.floor(F.col("doc_id") / 60).alias("hour"),
                                    "source_id").distinct()
        man = self.manifests.select("archive_id", "sequence", "manifest_hash", "operator_id", "signed_at")
        rows = seen.join(hours, ["archive_id", "hour"]).join(man, ["archive_id", "sequence"])
        name = F.concat("archive_id", F.lit(":"), F.col("sequence").cast("string"), F.lit(":"), "source_id")
        base = rows.select(
            "archive_id", F.lit(f"{schemas.NAMESPACE}.transparency.witness.v1").alias("attestation_type"),
            F.lit("1").alias("schema_version"), F.col("source_id").alias("witness_operator_id"),
            sha("key:", F.col("source_id")).alias("witness_public_key_fingerprint"),
            F.when(F.col("source_id") == "src7", sha("other")).otherwise(F.col("manifest_hash"))
            .alias("target_manifest_hash"),
            F.col("sequence").cast("long").alias("target_manifest_sequence"),
            F.when(F.col("source_id") == "src19", F.lit("someone")).otherwise(F.col("operator_id"))
            .alias("target_operator_id"),
            F.col("signed_at").alias("witnessed_at"), F.lit(None).cast("string").alias("statement"),
            F.concat(sha("a:", name), sha("b:", name)).alias("signature"),
            F.lit("ed25519").alias("signature_algorithm"))
        return base.withColumn("attestation_hash", canon.self_hash(base, "witness"))

    @cached_property
    def landed_keys(self) -> DataFrame:
        """Keys of registered sources and operators."""
        return self.sources.select(sha("key:", F.col("id")).alias("public_key_fingerprint")).unionByName(
            self.archives.select(sha("key:operator-", F.col("archive_id")).alias("public_key_fingerprint"))
        ).distinct()

    # --- derived artifacts -----------------------------------------------------------------

    @cached_property
    def current_manifests(self) -> DataFrame:
        return self.archives.select("archive_id", sha("am:", F.col("archive_id")).alias("manifest_hash"))

    @kept
    def workspace_inputs(self) -> tuple[DataFrame, DataFrame]:
        """One workspace per archive and source over its evidence and assessments."""
        name = F.concat("archive_id", F.lit("."), "source_id")
        ev = self.evidence.select("archive_id", name.alias("workspace_id"), F.lit("evidence").alias("reference_type"),
                                  F.col("hash").alias("identifier"))
        asm = (self.evidence.select("archive_id", name.alias("workspace_id"), F.col("hash").alias("evidence_id"))
               .join(self.assessments.select("archive_id", "evidence_id", "assessment_id"),
                     ["archive_id", "evidence_id"])
               .select("archive_id", "workspace_id", F.lit("assessment").alias("reference_type"),
                       F.col("assessment_id").alias("identifier")))
        heads = self.evidence.select("archive_id", name.alias("workspace_id"), "source_id").distinct()
        opaque = heads.select("archive_id", "workspace_id", F.lit("impact_analysis").alias("reference_type"),
                              F.concat(F.lit("impact-"), "source_id").alias("identifier"))
        headers = heads.select("archive_id", "workspace_id",
                               F.concat(F.lit("Case "), "workspace_id").alias("title"),
                               sha("am:", F.col("archive_id")).alias("source_manifest_hash"))
        return headers, ev.unionByName(asm).unionByName(opaque)

    @kept
    def workspaces(self) -> tuple[DataFrame, DataFrame]:
        return artifacts.build_workspace(*self.workspace_inputs)

    @kept
    def timelines(self) -> tuple[DataFrame, DataFrame]:
        heads, refs = self.workspaces
        named = heads.withColumn("timeline_id", F.concat("workspace_id", F.lit(".t")))
        return artifacts.build_timeline(named, refs, self.evidence, self.assessments)

    @kept
    def justifications(self) -> DataFrame:
        return artifacts.build_justification(self.assessments, self.evidence, self.provenance,
                                             self.current_manifests)

    # --- payload rows ----------------------------------------------------------------------

    def payload(self, df: DataFrame, table: str, row_id: str) -> DataFrame:
        """Rows in stored form: canonical payload and its digest."""
        present = set(df.columns)
        fields = {}
        for f in schemas.PAYLOADS[table].fields:
            if f.name == "authentication":
                value = F.struct(F.lit("unverified").alias("status"), *[
                    F.lit(None).cast("string").alias(n) for n in ("assessor", "assessed_at", "method", "notes")])
            elif f.name == "intrinsic_metadata":
                value = F.create_map().cast(schemas.STRING_MAP)
            elif f.name not in present:
                value = F.lit(None).cast(f.dataType)
            elif f.name in ("ingested_at", "created_at", "attested_at"):
                value = ids.iso_second(F.col(f.name))
            else:
                value = F.col(f.name).cast(f.dataType)
            fields[f.name] = (value, f.dataType)
        text = canonical_struct(fields)
        return df.select("archive_id", F.lit(table).alias("table"), F.col(row_id).alias("row_id"),
                         text.alias("payload")).withColumn("row_hash", F.sha2("payload", 256))

    @kept
    def rows(self) -> DataFrame:
        """All five tables in stored form."""
        steps = self.provenance.select("archive_id", "evidence_hash", F.explode("steps").alias("s")).select(
            "archive_id", "evidence_hash", "s.*").withColumn(
            "row_id", ids.step_id(F.col("evidence_hash"), F.col("step_id")))
        return reduce(DataFrame.unionByName, [
            self.payload(self.evidence, "evidence", "hash"), self.payload(self.sources, "sources", "id"),
            self.payload(self.provenance, "provenance", "evidence_hash"),
            self.payload(steps, "provenance_steps", "row_id"),
            self.payload(self.assessments, "authentication_assessments", "assessment_id")])

    # --- graphs ----------------------------------------------------------------------------

    @kept
    def graph(self) -> tuple[DataFrame, DataFrame]:
        return graph.build_graph(self.evidence, self.sources, self.assessments)

    @kept
    def trade_graph(self) -> tuple[DataFrame, DataFrame]:
        """Line to order to customer to nation to region, four levels deep."""
        line = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))

        def edge(df: DataFrame, src: str, src_id: Column, dst: str, dst_id: Column) -> DataFrame:
            return df.select(F.lit("trade").alias("archive_id"), F.lit(f"{src}_of").alias("kind"),
                             F.lit(src).alias("src_kind"), src_id.cast("string").alias("src_id"),
                             F.lit(dst).alias("dst_kind"), dst_id.cast("string").alias("dst_id"))

        edges = reduce(DataFrame.unionByName, [
            edge(self.table("lineitem"), "line", line, "order", F.col("l_orderkey")).distinct(),
            edge(self.table("orders"), "order", F.col("o_orderkey"), "customer", F.col("o_custkey")),
            edge(self.table("customer"), "customer", F.col("c_custkey"), "nation", F.col("c_nationkey")),
            edge(self.table("nation"), "nation", F.col("n_nationkey"), "region", F.col("n_regionkey"))])
        nodes = edges.select("archive_id", F.col("src_kind").alias("kind"), F.col("src_id").alias("id")).unionByName(
            edges.select("archive_id", F.col("dst_kind").alias("kind"), F.col("dst_id").alias("id"))).distinct()
        return nodes, edges

    # --- proofs ----------------------------------------------------------------------------

    @kept
    def proofs(self) -> Proofs:
        """One proof per conversation: turn 0 is the premise, each later turn a claim.

        Assistants argue by modus ponens from the two turns before (one, at turn 1:
        an arity fault), users by abduction from the turn before, others by a rule
        nobody knows. Where a user has the last word, turn 1 also rests on it: a cycle.
        """
        turns = self.table("conversations").select(
            F.lit("talk").alias("archive_id"), F.col("conv_id").cast("string").alias("proof_id"),
            F.col("turn").cast("int").alias("turn"), "role", F.sha2("text", 256).alias("text_hash"))
        key = ["archive_id", "proof_id"]
        claim = lambda n: F.concat(F.lit("c"), n.cast("string"))
        last = turns.groupBy(*key).agg(F.max("turn").alias("last"), F.max_by("role", "turn").alias("last_role"))
        later = turns.filter("turn > 0")
        rule = (F.when(F.col("role") == "assistant", "modus_ponens")
                .when(F.col("role") == "user", "abduction_to_best_explanation").otherwise("intuition"))
        name = F.concat(F.lit("i"), F.col("turn").cast("string"))
        before = later.select(*key, name.alias("inference_id"), claim(F.col("turn") - 1).alias("claim_id"))
        second = later.filter("role = 'assistant' AND turn > 1").select(
            *key, name.alias("inference_id"), claim(F.col("turn") - 2).alias("claim_id"))
        loop = last.filter("last > 0 AND last_role = 'user'").select(
            *key, F.lit("i1").alias("inference_id"), claim(F.col("last")).alias("claim_id"))
        heads = last.select(
            *key, F.lit(f"{schemas.NAMESPACE}.justification.inference-proof.v1").alias("proof_type"),
            sha("proof:", F.col("proof_id")).alias("proof_hash"),
            F.concat(F.lit("j"), F.col("proof_id")).alias("target_justification_id"),
            sha("just:", F.col("proof_id")).alias("target_justification_hash"),
            claim(F.col("last")).alias("conclusion_claim_id"))
        first = turns.filter("turn = 0")
        return Proofs(
            heads, first.select(*key, F.lit(0).alias("position"), F.lit("c0").alias("claim_id")),
            first.select(*key, F.lit(0).alias("position"), F.lit("c0").alias("claim_id"),
                         F.col("text_hash").alias("evidence_hash")),
            later.select(*key, name.alias("inference_id"), rule.alias("rule"), claim(F.col("turn")).alias("output_id")),
            reduce(DataFrame.unionByName, [before, second, loop]),
            later.select(*key, claim(F.col("turn")).alias("claim_id"), name.alias("inferred_by")))

    @kept
    def case_proofs(self) -> Proofs:
        """One proof per workspace: labelled evidence backs one premise, all of it another."""
        key = ["archive_id", "proof_id"]
        rows = self.labelled.withColumn("proof_id", F.concat("archive_id", F.lit("."), "source_id"))
        good = rows.filter("quality = 1").select(
            *key, F.lit(0).alias("position"), F.lit("p0").alias("claim_id"), F.col("hash").alias("evidence_hash"))
        every = rows.select(
            *key, F.lit(1).alias("position"), F.lit("p1").alias("claim_id"), F.col("hash").alias("evidence_hash"))
        heads = rows.select(*key).distinct()
        name = F.col("proof_id")
        two = F.array(F.lit("p0"), F.lit("p1"))
        return Proofs(
            heads.select(*key, F.lit(f"{schemas.NAMESPACE}.justification.inference-proof.v1").alias("proof_type"),
                         sha("proof:", name).alias("proof_hash"), F.concat(F.lit("j-"), name).alias(
                             "target_justification_id"),
                         sha("just:", name).alias("target_justification_hash"),
                         F.lit("q0").alias("conclusion_claim_id")),
            heads.select(*key, F.posexplode(two).alias("position", "claim_id")),
            good.unionByName(every),
            heads.select(*key, F.lit("s0").alias("inference_id"),
                         F.lit("abduction_to_best_explanation").alias("rule"), F.lit("q0").alias("output_id")),
            heads.select(*key, F.lit("s0").alias("inference_id"), F.explode(two).alias("claim_id")),
            heads.select(*key, F.lit("q0").alias("claim_id"), F.lit("s0").alias("inferred_by")))

    # --- blobs -----------------------------------------------------------------------------

    @cached_property
    def blobs(self) -> DataFrame:
        """Page bytes under the hash in their path; mobile pages were overwritten."""
        site = F.regexp_extract("url", "\\.([a-z]+)/", 1)
        moved = F.contains("url", F.lit("//m."))
        return self.table("pages").select(
            site.alias("archive_id"), F.when(moved, F.sha2("url", 256)).otherwise(F.sha2("html", 256)).alias("hash"),
            F.encode("html", "UTF-8").alias("content"))
