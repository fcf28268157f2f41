"""Streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlens.operators import chains
from provlens.session import stable


def _folder_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def stream_ingest(blobs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """First arrival per content hash within the watermark.

    ``blobs``: ``archive_id, hash, arrived_at``. Copies later than the watermark
    pass; :func:`upsert_new` drops those exactly.
    """
    return blobs.withWatermark("arrived_at", watermark).dropDuplicatesWithinWatermark(["archive_id", "hash"])


def upsert_new(path: str):
    """A ``foreachBatch`` body that appends only hashes the table does not hold."""
    def write(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = batch.dropDuplicates(["archive_id", "hash"])
        if _folder_exists(spark, path):
            held = spark.read.parquet(path).select("archive_id", "hash")
            fresh = fresh.join(held, ["archive_id", "hash"], "left_anti")
        fresh.write.mode("append").partitionBy("archive_id").parquet(path)

    return write


def replace_table(path: str):
    """A ``foreachBatch`` body for complete results: the table is what the last batch says."""
    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return write


def follow_chain(state_path: str, failures_path: str):
    """A ``foreachBatch`` body that checks growing logs across micro-batches.

    Inside a batch entries are linked by position like a table. What crosses
    batches is one row per archive, the last ``(seq, entry_hash)``, kept per batch
    id, so a repeated batch starts from the same state. Batches must bring the
    entries of a log in order and without holes in ``pos``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        links = chains.chain_links(batch)
        firsts = batch.groupBy("archive_id").agg(F.min("pos").alias("first_pos"))
        heads = batch.groupBy("archive_id").agg(
            F.max_by("seq", "pos").alias("last_seq"), F.max_by("entry_hash", "pos").alias("last_hash"))
        before = f"{state_path}/batch={batch_id - 1}"
        if batch_id and _folder_exists(spark, before):
            known = spark.read.parquet(before)
            links = (links.join(firsts.join(known, "archive_id"), "archive_id", "left")
                     .withColumn("expected_seq", F.when(F.col("pos") == F.col("first_pos"), F.col("last_seq") + 1)
                                 .otherwise(F.col("expected_seq")))
                     .withColumn("expected_prev_hash",
                                 F.when(F.col("pos") == F.col("first_pos"), F.col("last_hash"))
                                 .otherwise(F.col("expected_prev_hash"))))
            heads = heads.unionByName(known.join(heads, "archive_id", "left_anti"))
        failed = links.select("archive_id", "pos", "seq", chains.link_failures().alias("reason"))
        failed.filter("reason IS NOT NULL").write.mode("overwrite").parquet(f"{failures_path}/batch={batch_id}")
        heads.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    return write


def stream_action_counts(log: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Entries per window and action; ``timestamp`` must be a timestamp here.

    In update mode with :func:`merge_counts`, windows behind the watermark leave the state.
    """
    return (log.withWatermark("timestamp", watermark)
            .groupBy(F.window("timestamp", window).alias("w"), "action").agg(F.count("*").alias("count"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "action", "count"))




def merge_counts(path: str):
    """A ``foreachBatch`` body for update mode: new totals replace those of their window and action.

    A window's rows lie in a folder per version. A batch reads and rewrites only windows that it
    has a new total for, as the version of its own number, so a repeated batch writes the same.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = stable(batch)
        if _folder_exists(spark, path):
            touched = [r["window_start"] for r in fresh.select("window_start").distinct().collect()]  # open windows only
            held = _newest(spark.read.parquet(path).filter(F.col("window_start").isin(touched) & (F.col("version") < batch_id)))
            fresh = stable(fresh.unionByName(held.join(fresh, ["window_start", "action"], "left_anti")))
        (fresh.withColumn("version", F.lit(batch_id)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
         .partitionBy("window_start", "version").parquet(path))

    return write


def _newest(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("window_start").agg(F.max("version").alias("version"))
    return rows.join(last, ["window_start", "version"], "left_semi").select("window_start", "window_end", "action", "count")


def merged_counts(spark: SparkSession, path: str) -> DataFrame:
    """The totals that :func:`merge_counts` has written: the newest version of each window."""
    return _newest(spark.read.parquet(path))
