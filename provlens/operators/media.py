"""Verdicts over already parsed media-manifest chains and certificate chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def media_chain_status(manifests: DataFrame) -> DataFrame:
    """First failing rule of each evidence's manifest chain, null when it holds.

    ``manifests``: ``archive_id, evidence_sha256, label, parent_label,
    signature_verified, declared_sha256``.
    """
    key = ["archive_id", "evidence_sha256"]
    # A row stands for its own label and, as a child, for its parent's: one grouping finds copies,
    # children and unknown parents. Of the declared hash only its verdict is shuffled.
    own = F.struct(
        F.col("label"), F.lit(1).alias("copies"), F.col("parent_label").isNull().cast("int").alias("roots"),
        (~F.coalesce("signature_verified", F.lit(False))).cast("int").alias("unsigned"), F.lit(0).alias("children"),
        F.col("declared_sha256").isNotNull().alias("declares"),
        (F.lower("declared_sha256") != F.lower("evidence_sha256")).alias("differs"))
    above = F.struct(
        F.col("parent_label").alias("label"), F.lit(0).alias("copies"), F.lit(0).alias("roots"), F.lit(0).alias("unsigned"),
        F.lit(1).alias("children"), F.lit(False).alias("declares"), F.lit(None).cast("boolean").alias("differs"))
    both = manifests.select(*key, F.explode(F.when(F.col("parent_label").isNull(), F.array(own)).otherwise(F.array(own, above))).alias("r"))
    # Without a key a parent is nobody's.
    apart = F.when(reduce(Column.__or__, [F.col(k).isNull() for k in key]), F.col("r.children") > 0)
    labels = both.select(*key, "r.*", apart.alias("apart")).groupBy(*key, "label", "apart").agg(
        *[F.sum(c).alias(c) for c in ("copies", "roots", "unsigned", "children")],
        F.bool_or("declares").alias("declares"), F.bool_or("differs").alias("differs"))
    leaf = (F.col("copies") > 0) & (F.col("children") == 0)
    facts = labels.groupBy(*key).agg(
        F.sum(F.when(F.col("copies") > 0, F.col("roots"))).alias("roots"), F.max("copies").alias("most_copies"),
        F.count_if(F.col("copies") == 0).alias("unknown_parents"),
        F.sum("unsigned").alias("unsigned"),
        F.sum(F.when(leaf, F.col("copies")).otherwise(0)).alias("leaves"),
        F.bool_or(leaf & F.col("declares")).alias("declares"), F.bool_or(leaf & F.col("differs")).alias("differs"))
    reason = (F.when(F.col("roots") != 1, F.concat(F.lit("expected one root, found "),
                                                   F.col("roots").cast("string")))
              .when(F.col("most_copies") > 1, F.lit("duplicate labels"))
              .when(F.col("unknown_parents") > 0, F.lit("unknown parent"))
              .when(F.col("unsigned") > 0, F.lit("signature did not verify"))
              .when(F.col("leaves") != 1, F.concat(F.lit("expected one leaf, found "),
                                                   F.col("leaves").cast("string")))
              .when(~F.col("declares"), F.lit("leaf has no hash assertion"))
              .when(F.col("differs"), F.lit("leaf hash differs")))
    return facts.select(*key, reason.isNull().alias("chain_verified"), reason.alias("failure_reason"))


def certificate_window(chains: DataFrame, anchors: DataFrame, moment) -> DataFrame:
    """Validity windows and trust anchor of certificate chains at ``moment``.

    ``chains``: ``archive_id, chain_id, position, certificate_id, not_before,
    not_after``; ``anchors``: ``certificate_id``. The last certificate is the root.
    """
    key = ["archive_id", "chain_id"]
    known = anchors.select("certificate_id", F.lit(True).alias("anchored")).distinct()
    at = F.lit(moment).cast("timestamp") if isinstance(moment, str) else moment
    pos = F.col("position").cast("string")
    fault = (F.when(at < F.col("not_before"), F.concat(F.lit("cert["), pos, F.lit("] is not yet valid")))
             .when(at > F.col("not_after"), F.concat(F.lit("cert["), pos, F.lit("] has expired"))))
    facts = (chains.join(known, "certificate_id", "left").withColumn("fault", fault).groupBy(*key).agg(
        F.min(F.when(F.col("fault").isNotNull(), F.struct("position", "fault"))).alias("first"),
        F.max_by(F.coalesce("anchored", F.lit(False)), "position").alias("root_anchored")))
    reason = F.when(F.col("first").isNotNull(), F.col("first.fault")).when(
        ~F.col("root_anchored"), F.lit("root certificate is not in the trust list"))
    return facts.select(*key, reason.isNull().alias("verified"), reason.alias("reason"))
