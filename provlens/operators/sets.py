"""Differences between snapshots, justifications, archives and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens import schemas
from provlens.functions import canonical as canon
from provlens.functions.documents import items, record_digest
from provlens.functions.ordered import sequenced

_TRIPLE = ["reference_type", "identifier", "artifact_hash"]
_ENTRY = ["entry_role", "entry_identifier", "entry_hash"]


def _changes(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """``change`` of every distinct row of either side; copies combine map-side."""
    both = a.select(*columns, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(*columns, F.lit(0).alias("a"), F.lit(1).alias("b")))
    found = both.groupBy(*columns).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return found.select(*columns, F.when(F.col("a") == 0, F.lit("added"))
                        .when(F.col("b") == 0, F.lit("removed"))
                        .otherwise(F.lit("unchanged")).alias("change"))


def _diff_hash(changes: DataFrame, headers: DataFrame, keys: list[str], noun: str,
               sides: tuple[str, str], columns: list[str]) -> DataFrame:
    """Digest of the diff record; ``headers`` has the keys and the two side hashes."""
    text = canon.canonical_struct({c: (F.col(c), schemas.S) for c in columns})
    order = F.concat_ws("\x00", *columns)
    record = {f"{change}_{noun}": items(changes.filter(F.col("change") == change), keys, order, text)
              for change in ("added", "removed", "unchanged")}
    record |= {side: canon.json_text(F.col(side)) for side in sides}
    record["schema_version"] = canon.json_text(F.lit(schemas.ARTIFACT_SCHEMA_VERSION))
    return record_digest(headers, keys, record, "diff_hash")


def snapshot_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Added, removed and unchanged references; both sides in long form."""
    return _changes(a, b, [*keys, *_TRIPLE])


def snapshot_diff_hash(changes: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """``headers``: keys, ``snapshot_a_hash``, ``snapshot_b_hash``."""
    return _diff_hash(changes, headers, keys, "artifacts", ("snapshot_a_hash", "snapshot_b_hash"), _TRIPLE)


def justification_entries(justifications: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of all five categories in long form."""
    merged = F.flatten(F.array("minimal_evidence", "supporting_assessments", "graph_nodes_used",
                               "intermediate_artifacts", "provenance_chain"))
    return justifications.select(*keys, F.explode(merged).alias("e")).select(*keys, "e.*")


def justification_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _changes(a, b, [*keys, *_ENTRY])


def justification_diff_hash(changes: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    return _diff_hash(changes, headers, keys, "entries",
                      ("justification_a_hash", "justification_b_hash"), _ENTRY)


# --- archives ------------------------------------------------------------------------------

# Parameters that follow from the content, so every archive must record the same.
CONTENT_PARAMETERS = ["size_bytes"]


def compare_archives(a: DataFrame, b: DataFrame, keys: list[str] | None = None,
                     certificates_a: DataFrame | None = None,
                     certificates_b: DataFrame | None = None) -> DataFrame:
    """Where each evidence occurs and whether both sides describe it alike.

    ``a`` and ``b`` hold the newest ingest parameters, one row per ``hash`` (and
    ``keys``, when many pairs are compared at once).
    """
    on = [*(keys or []), "hash"]

    def side(df: DataFrame, certificates: DataFrame | None, tag: str) -> DataFrame:
        out = df.select(*on, F.col("parameters").alias(f"parameters_{tag}"), F.lit(True).alias(f"in_{tag}"))
        if certificates is None:
            return out.withColumn(f"certificate_{tag}", F.lit(None).cast("string"))
        named = certificates.groupBy(*(keys or []), F.lower("evidence_sha256").alias("hash")).agg(
            F.min("certificate_hash").alias(f"certificate_{tag}"))
        return out.join(named, on, "left")

    joined = side(a, certificates_a, "a").join(side(b, certificates_b, "b"), on, "full_outer")
    shared = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    differing = F.array_compact(F.array(*[
        F.when(~F.element_at("parameters_a", p).eqNullSafe(F.element_at("parameters_b", p)), F.lit(p))
        for p in CONTENT_PARAMETERS]))
    certificate_match = F.when(shared, F.col("certificate_a") == F.col("certificate_b"))
    return joined.select(
        *on,
        F.when(shared, F.lit("shared")).when(F.col("in_b").isNull(), F.lit("a_only"))
        .otherwise(F.lit("b_only")).alias("presence"),
        F.when(shared, F.size(differing) == 0).alias("parameters_match"),
        F.when(shared, F.array_join(differing, ",")).alias("diverging_fields"),
        "certificate_a", "certificate_b", certificate_match.alias("certificate_match"),
        F.coalesce(shared & ((F.size(differing) > 0) | ~F.coalesce(certificate_match, F.lit(True))),
                   F.lit(False)).alias("has_divergence"))


def compare_pairs(ingests: DataFrame, pairs: DataFrame) -> DataFrame:
    """:func:`compare_archives` for every listed pair (``archive_a``, ``archive_b``).

    Only the pairs asked for are expanded, so the work follows the pair list.
    """
    keys = ["archive_a", "archive_b"]
    a = ingests.withColumnRenamed("archive_id", "archive_a").join(pairs, "archive_a")
    b = ingests.withColumnRenamed("archive_id", "archive_b").join(pairs, "archive_b")
    return compare_archives(a, b, keys)


def compare_proofs(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Proofs by id: equal only with the same hash and the same target."""
    on = [*(keys or []), "proof_id"]
    kept = ("proof_hash", "target_justification_hash")
    left = a.select(*on, *[F.col(c).alias(f"{c}_a") for c in kept], F.lit(True).alias("in_a"))
    right = b.select(*on, *[F.col(c).alias(f"{c}_b") for c in kept], F.lit(True).alias("in_b"))
    shared = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    same = reduce(lambda x, y: x & y, [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in kept])
    return left.join(right, on, "full_outer").select(
        *on,
        F.when(shared, F.lit("shared")).when(F.col("in_b").isNull(), F.lit("a_only"))
        .otherwise(F.lit("b_only")).alias("presence"),
        "proof_hash_a", "proof_hash_b", F.when(shared, same).alias("matches"))


# --- manifests and sequences ---------------------------------------------------------------


def manifest_diff(stored: DataFrame, stored_tables: DataFrame, recomputed: DataFrame,
                  recomputed_tables: DataFrame) -> DataFrame:
    """One row per field in which a stored manifest departs from the recomputed one.

    Headers carry ``schema_version, blobs_root, notes``; table frames carry
    ``row_count, schema_hash, partition_digest``. ``generated_at`` and
    ``software_version`` may differ.
    """
    fields = ("schema_version", "blobs_root", "notes")
    table_fields = ("row_count", "schema_hash", "partition_digest")

    def clash(names: tuple[str, ...], prefix) -> Column:
        return F.array_compact(F.array(*[
            F.when(~F.col(f"s.{n}").eqNullSafe(F.col(f"r.{n}")), F.struct(
                F.concat(prefix, F.lit(n)).alias("field"), F.col(f"s.{n}").cast("string").alias("stored"),
                F.col(f"r.{n}").cast("string").alias("recomputed"))) for n in names]))

    heads = (stored.select("archive_id", F.struct(*fields).alias("s"))
             .join(recomputed.select("archive_id", F.struct(*fields).alias("r")), "archive_id")
             .select("archive_id", F.explode(clash(fields, F.lit(""))).alias("d")))
    sides = (stored_tables.select("archive_id", "table", F.struct(*table_fields).alias("s"))
             .join(recomputed_tables.select("archive_id", "table", F.struct(*table_fields).alias("r")),
                   ["archive_id", "table"], "full_outer"))
    prefix = F.concat(F.lit("tables."), F.col("table"), F.lit("."))
    absent = lambda state: F.array(F.struct(
        F.concat(F.lit("tables."), F.col("table")).alias("field"),
        F.lit("absent" if state == "missing" else "present").alias("stored"),
        F.lit("present" if state == "missing" else "absent").alias("recomputed")))
    tables = sides.select("archive_id", F.explode(
        F.when(F.col("s").isNull(), absent("missing")).when(F.col("r").isNull(), absent("extra"))
        .otherwise(clash(table_fields, prefix))).alias("d"))
    return heads.unionByName(tables).select("archive_id", "d.*")


GAP_PIECE = 1 << 16


def sequence_gap_ranges(manifests: DataFrame) -> DataFrame:
    """First and last number of each gap between the first and last of each log; of any width."""
    rows = sequenced(manifests.select("archive_id", "sequence"), ["archive_id"], ["sequence"], ["sequence"])
    return (rows.filter(F.col("sequence") - F.col("prev_sequence") > 1)
            .select("archive_id", (F.col("prev_sequence") + 1).alias("first_missing"),
                    (F.col("sequence") - 1).alias("last_missing")))


def sequence_gaps(manifests: DataFrame) -> DataFrame:
    """Missing sequence numbers between the first and last of each log, a row each.

    A wide gap is cut into pieces and those into pieces again, so no array is longer than
    65,536 numbers below a width of 2^48, and the rows of one gap are made in many tasks.
    """
    pieces = sequence_gap_ranges(manifests)
    for width in (GAP_PIECE * GAP_PIECE, GAP_PIECE):
        begin = F.explode(F.sequence("first_missing", "last_missing", F.lit(width).cast("long")))
        pieces = (pieces.select("archive_id", begin.alias("begin"), "last_missing")
                  .select("archive_id", F.col("begin").alias("first_missing"),
                          F.least("last_missing", F.col("begin") + width - 1).alias("last_missing")))
        pieces = pieces.repartition("archive_id", "first_missing")
    return pieces.select("archive_id", F.explode(F.sequence("first_missing", "last_missing")).alias("missing_sequence"))


def duplicate_refs(references: DataFrame, keys: list[str]) -> DataFrame:
    return (references.groupBy(*keys, "reference_type", "identifier")
            .agg(F.count("*").alias("occurrences")).filter("occurrences > 1"))
