"""Hash-chained logs: verification in parallel, extension in bounded rounds."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlens import schemas
from provlens.functions import canonical as canon
from provlens.functions.ordered import GROUP_ROWS, largest_group, sequenced
from provlens.session import ensure_checkpoint_dir, landed

# Entries per window group; one log spreads over many groups.
SPAN = 1 << 16
ROUND_ROWS = 2_000_000


def chain_links(log: DataFrame) -> DataFrame:
    """Expected sequence number and previous hash of every entry, by position.

    ``pos`` is dense per archive, so a log is cut into spans of positions and the
    last entry of a span is also sent to the next one: one shuffle of narrow rows,
    no group larger than a span.
    """
    narrow = log.select("archive_id", "pos", "seq", "prev_hash", "entry_hash",
                        canon.entry_hash(log).alias("computed_hash"))
    span = F.floor(F.col("pos") / SPAN)
    spans = F.when((F.col("pos") + 1) % SPAN == 0, F.array(span, span + 1)).otherwise(F.array(span))
    order = Window.partitionBy("archive_id", "_span").orderBy("pos")
    linked = (narrow.withColumn("_home", span).withColumn("_span", F.explode(spans))
              .withColumn("_seq", F.lag("seq").over(order))
              .withColumn("_hash", F.lag("entry_hash").over(order))
              .filter(F.col("_home") == F.col("_span")))
    return linked.select(
        "archive_id", "pos", "seq", "prev_hash", "entry_hash", "computed_hash",
        F.coalesce(F.col("_seq") + 1, F.lit(0)).alias("expected_seq"),
        F.coalesce("_hash", F.lit(schemas.ZERO_HASH)).alias("expected_prev_hash"))


def _short(c: str) -> Column:
    return F.concat(F.substring(c, 1, 8), F.lit("…"))


def link_failures() -> Column:
    """First failing property of an entry: sequence, then link, then own hash."""
    seq = F.col("seq").cast("string")
    return (F.when(F.col("seq") != F.col("expected_seq"), F.concat(
                F.lit("seq mismatch at entry "), seq, F.lit(": expected seq="),
                F.col("expected_seq").cast("string"), F.lit(".")))
            .when(F.col("prev_hash") != F.col("expected_prev_hash"), F.concat(
                F.lit("prev_hash mismatch at seq="), seq, F.lit(": expected "),
                _short("expected_prev_hash"), F.lit(", found "), _short("prev_hash"), F.lit(".")))
            .when(F.col("computed_hash") != F.col("entry_hash"), F.concat(
                F.lit("entry_hash mismatch at seq="), seq, F.lit(": stored "), _short("entry_hash"),
                F.lit(", recomputed "), _short("computed_hash"), F.lit("."))))


def verify_chain(log: DataFrame) -> DataFrame:
    """Per archive: entries, verdict, and the first failure in log order."""
    links = chain_links(log)
    checked = links.select("archive_id", "pos", "seq", link_failures().alias("reason"))
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("pos", "seq", "reason")))
    return (checked.groupBy("archive_id").agg(F.count("*").alias("total_entries"), first.alias("f"))
            .select("archive_id", F.col("f").isNull().alias("ok"), "total_entries",
                    F.col("f.seq").alias("first_failure_seq"),
                    F.col("f.reason").alias("first_failure_reason")))


def verify_chain_all(log: DataFrame) -> DataFrame:
    """Every broken hash and link, with entries put in sequence order first."""
    narrow = log.select("archive_id", "pos", "seq", "prev_hash", "entry_hash",
                        (canon.entry_hash(log) == F.col("entry_hash")).alias("hash_ok"))
    rows = sequenced(narrow, ["archive_id"], ["seq", "pos"], ["seq", "entry_hash"])
    start = narrow.groupBy("archive_id").agg(F.min("seq").alias("start"))
    rows = rows.join(start, "archive_id")
    expected = F.col("position") + F.col("start")
    first = F.col("position") == 0
    broken = F.array_compact(F.array(
        F.when(F.col("seq") != expected, F.concat(
            F.lit("sequence break: expected "), expected.cast("string"), F.lit(", got "),
            F.col("seq").cast("string"))),
        F.when(~F.col("hash_ok"), F.lit("entry_hash mismatch")),
        F.when(first & (F.col("start") == 0) & (F.col("prev_hash") != schemas.ZERO_HASH),
               F.lit("bootstrap entry (seq=0) must have prev_hash = 0*64"))
        .when(~first & (F.col("prev_hash") != F.col("prev_entry_hash")), F.concat(
            F.lit("prev_hash does not match entry_hash of seq "), F.col("prev_seq").cast("string")))))
    return (rows.select("archive_id", "seq", F.explode(broken).alias("reason"))
            .orderBy("archive_id", "seq", "reason"))


def verify_transparency_chain(manifests: DataFrame) -> DataFrame:
    """Per log: sequence equals index, self-hash holds, link holds; first failure."""
    narrow = manifests.select(
        "archive_id", "sequence", "previous_manifest_hash", "manifest_hash",
        (canon.self_hash(manifests, "transparency_manifest") == F.col("manifest_hash")).alias("intact"))
    rows = sequenced(narrow, ["archive_id"], ["sequence"], ["manifest_hash"])
    expected = F.coalesce("prev_manifest_hash", F.lit(schemas.ZERO_HASH))
    seq, at = F.col("sequence").cast("string"), F.col("position").cast("string")
    reason = (F.when(F.col("sequence") != F.col("position"), F.concat(
                  F.lit("sequence mismatch at index "), at, F.lit(": expected "), at,
                  F.lit(", got "), seq))
              .when(~F.col("intact"), F.concat(
                  F.lit("manifest at sequence "), seq, F.lit(" failed structural verification")))
              .when(F.col("previous_manifest_hash") != expected, F.concat(
                  F.lit("chain break at sequence "), seq, F.lit(": previous_manifest_hash="),
                  F.substring("previous_manifest_hash", 1, 16), F.lit("…, expected "),
                  F.substring(expected, 1, 16), F.lit("…"))))
    first = F.min(F.when(reason.isNotNull(), F.struct("position", reason.alias("reason"))))
    return (rows.groupBy("archive_id").agg(F.count("*").alias("manifest_count"), first.alias("f"))
            .select("archive_id", "manifest_count", F.col("f").isNull().alias("ok"),
                    F.col("f.reason").alias("reason")))


def chain_head(log: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """Last hash and number of entries; the zero hash for a log without entries."""
    heads = log.groupBy("archive_id").agg(
        F.max_by("entry_hash", "pos").alias("head_hash"), F.count("*").alias("total"))
    if archives is None:
        return heads
    return archives.select("archive_id").join(heads, "archive_id", "left").select(
        "archive_id", F.coalesce("head_hash", F.lit(schemas.ZERO_HASH)).alias("head_hash"),
        F.coalesce("total", F.lit(0)).alias("total"))


def _folding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link rows that come in order of archive and position; one digest of state.

    A row without text, in front of an archive's others, brings the hash to start from.
    """
    archive, before = None, schemas.ZERO_HASH
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("left", "right")]
        text = batch.schema.field("archive_id").type
        linked, prev, own = [], [], []
        for key, left, right in zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist()
                                      for n in ("archive_id", "left", "right")]):
            linked.append(left is not None)
            if left is None:
                archive, before = key, right
                continue
            if key != archive:
                archive, before = key, schemas.ZERO_HASH
            prev.append(before)
            before = hashlib.sha256((left + before + right).encode("utf-8")).hexdigest()
            own.append(before)
        rows = batch if all(linked) else batch.filter(pa.array(linked, pa.bool_()))
        yield pa.RecordBatch.from_arrays(
            [*[rows.column(rows.schema.get_field_index(n)) for n in names], pa.array(prev, text), pa.array(own, text)],
            [*names, "prev_hash", "entry_hash"])


def fold_chain(texts: DataFrame, heads: DataFrame | None = None, round_rows: int = ROUND_ROWS,
               carry: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """Link canonical texts into chains: ``archive_id, position, *carry, prev_hash, entry_hash``.

    ``texts`` has ``archive_id``, dense ``position``, the canonical text around
    the previous hash (``left``, ``right``), made in parallel beforehand, and the columns
    to ``carry`` along; ``heads`` may give the ``start_hash`` of every archive. A chain is
    sequential, so what is left per entry is one digest, fed row by row. A long chain advances
    ``round_rows`` entries per round and each round is written before the next, so
    losing an executor costs at most one round. Texts are written once, a folder per
    round, so a round reads its own rows only. ``whole`` says that no chain is longer than
    ``GROUP_ROWS`` and ``sequenced`` left each of them in one task: then texts without heads are
    neither written nor shuffled again.
    """
    spark = texts.sparkSession
    texts = texts.select("archive_id", "position", "left", "right", *carry)
    schema = T.StructType([*[f for f in texts.schema.fields if f.name not in ("left", "right")],
                           T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])

    def folded(part: DataFrame) -> DataFrame:
        return part.sortWithinPartitions("archive_id", "position").mapInArrow(_folding, schema)

    if heads is None and whole:
        return folded(texts)
    path = f"{ensure_checkpoint_dir(spark)}/texts-{uuid.uuid4().hex}"
    (texts.withColumn("_round", F.floor(F.col("position") / round_rows).cast("long"))
     .write.partitionBy("_round").parquet(path))
    written = spark.read.schema(T.StructType([*texts.schema.fields, T.StructField("_round", T.LongType())])).parquet(path)
    last = written.agg(F.max("_round").alias("m")).first()["m"]
    done: list[DataFrame] = []
    for number in range((last if last is not None else -1) + 1):
        part = spark.read.schema(texts.schema).parquet(f"{path}/_round={number}")
        if heads is not None:
            # Heads travel as rows in front of their archive. A join would leave rows hash
            # partitioned already, Spark would then drop the repartition, and a skewed join
            # could deal one archive out to several tasks.
            part = part.unionByName(heads.select(
                "archive_id", F.lit(-1).cast("long").alias("position"), F.lit(None).cast("string").alias("left"),
                F.col("start_hash").alias("right")), allowMissingColumns=True)
        linked = landed(folded(part.repartition("archive_id")))
        done.append(linked)
        heads = linked.groupBy("archive_id").agg(F.max_by("entry_hash", "position").alias("start_hash"))
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], schema)


def append_chain(log: DataFrame | None, new: DataFrame, order: list[str],
                 round_rows: int = ROUND_ROWS) -> DataFrame:
    """Number and chain new entries after the log; returns complete audit rows.

    ``new`` has the entry columns without ``seq``, ``prev_hash`` and ``entry_hash``;
    ``order`` says in which order they were recorded.
    """
    longest = largest_group(new, ["archive_id"])
    placed = sequenced(new, ["archive_id"], order, largest=longest)
    if log is not None:
        heads = chain_head(log).select("archive_id", F.col("head_hash").alias("start_hash"), "total")
        starts = new.select("archive_id").distinct().join(heads, "archive_id", "left").select(
            "archive_id", F.coalesce("start_hash", F.lit(schemas.ZERO_HASH)).alias("start_hash"),
            F.coalesce("total", F.lit(0)).alias("total"))
        placed = placed.join(starts.select("archive_id", "total"), "archive_id")
        heads = starts.select("archive_id", "start_hash")
    else:
        placed, heads = placed.withColumn("total", F.lit(0)), None
    placed = placed.withColumn("seq", F.col("position") + F.col("total")).drop("total")
    fields = {f.name: f.dataType for f in schemas.AUDIT_ENTRY.fields}
    before = ["action", "actor", "parameters"]
    after = ["result", "schema_version", "seq", "target", "timestamp"]
    head = canon.canonical_struct({n: (F.col(n), placed.schema[n].dataType) for n in before})
    tail = canon.canonical_struct({n: (F.col(n), placed.schema[n].dataType) for n in after})
    carry = [n for n in fields if n not in ("prev_hash", "entry_hash")]
    texts = placed.select(
        "archive_id", "position", *carry,
        F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"prev_hash":"')).alias("left"),
        F.concat(F.lit('",'), F.substring(tail, F.lit(2), F.length(tail))).alias("right"))
    linked = fold_chain(texts, heads, round_rows, carry, whole=longest <= min(GROUP_ROWS, round_rows))
    return linked.withColumn("pos", F.col("seq")).select("archive_id", "pos", *fields)


def rank_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """Dense position of events in a timeline; equal times fall back on the hash."""
    return sequenced(events, keys, ["observed_at", "artifact_hash", "artifact_type",
                                    "artifact_identifier", "source_reference"])


def dedupe_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key, found by a map-side combined ``min_by``."""
    rest = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
            .select(*keys, "first.*"))


def next_sequence(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("archive_id").agg(
        (F.max("sequence") + 1).alias("next_sequence"),
        F.max_by("manifest_hash", "sequence").alias("previous_manifest_hash"))


# --- order and paging ----------------------------------------------------------------------


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("archive_id", "kind", "id")


def canonical_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("archive_id", "kind", "src_kind", "src_id", "dst_kind", "dst_id")


def page(log: DataFrame, offset: int, limit: int) -> DataFrame:
    """Entries ``offset`` to ``offset + limit`` of each log with the log's total."""
    totals = log.groupBy("archive_id").agg(F.count("*").alias("total"))
    return (log.filter(F.col("pos").between(offset, offset + limit - 1))
            .join(totals, "archive_id").orderBy("archive_id", "pos"))


def list_assessments(assessments: DataFrame, evidence_id: str | None = None) -> DataFrame:
    out = assessments if evidence_id is None else assessments.filter(F.col("evidence_id") == evidence_id)
    return out.orderBy("archive_id", "assessment_id")


def head_manifest(manifests: DataFrame) -> DataFrame:
    rest = [c for c in manifests.columns if c != "archive_id"]
    return (manifests.groupBy("archive_id")
            .agg(F.max_by(F.struct(*rest), "sequence").alias("head")).select("archive_id", "head.*"))
