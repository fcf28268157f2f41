"""Ordered work over groups of any size.

A group (one archive, one timeline) may hold a third of all rows, so neither of
these gathers a large one: rows are range-partitioned by group *and* order, which cuts
it into many partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlens.session import stable

BLOCK_CHARS = 1 << 20
# Rows of a key that are put in order in one task.
GROUP_ROWS = 1 << 16


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most of them; only the keys are read."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def sequenced(df: DataFrame, keys: list[str], order: list[str],
              previous: list[str] | None = None, largest: int | None = None) -> DataFrame:
    """Add ``position`` (0-based, dense, per key) and ``prev_<c>`` for ``previous``.

    Where no key has more than ``GROUP_ROWS`` rows, a key is numbered as a whole, in one shuffle.
    Otherwise row numbers and lags run inside slices of a key; a table with one row per
    slice supplies the offset and the row that comes before it. Rows without a key drop out.
    ``largest`` may give the rows of the largest key where they are counted already.
    """
    previous = previous or []
    if keys and (largest_group(df, keys) if largest is None else largest) <= GROUP_ROWS:
        whole = Window.partitionBy(*keys).orderBy(*order)
        rows = df.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
        return rows.select(
            *keys, *[c for c in df.columns if c not in keys],
            *[F.lag(c).over(whole).alias(f"prev_{c}") for c in previous],
            (F.row_number().over(whole) - 1).cast("long").alias("position"))
    ranged = stable(df.repartitionByRange(*keys, *order)
                    .withColumn("_slice", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    rows = ranged.withColumn("_n", F.row_number().over(inside) - 1)
    for c in previous:
        rows = rows.withColumn(f"prev_{c}", F.lag(c).over(inside))
    tail = F.max_by(F.struct(*previous), F.struct(*order)) if previous else F.lit(None)
    slices = ranged.groupBy(*keys, "_slice").agg(F.count("*").alias("_rows"), tail.alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    slices = slices.select(
        *keys, "_slice",
        F.coalesce(F.sum("_rows").over(across.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"),
        F.lag("_tail").over(across).alias("_before"))
    out = rows.join(slices, [*keys, "_slice"]).withColumn("position", F.col("_n") + F.col("_offset"))
    for c in previous:
        out = out.withColumn(
            f"prev_{c}", F.when(F.col("_n") == 0, F.col(f"_before.{c}")).otherwise(F.col(f"prev_{c}")))
    return out.drop("_n", "_offset", "_slice", "_before")


def document_digest(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 per key over text fragments put in order; columns ``keys, digest``.

    ``fragments`` has the keys, ``part`` (long, order of sections), ``ord``
    (string, order inside a section), ``item`` (boolean) and ``text``. Items of one
    section are joined by commas, everything else is put end to end.

    Sections are packed into blocks in parallel; one task per key then feeds the
    blocks, already in order, to the hash, holding one block at a time. A flat
    digest is sequential by definition, so that last step cannot be split further.
    """
    key_fields = [fragments.schema[k] for k in keys]
    pack_schema = T.StructType(key_fields + [
        T.StructField("part", T.LongType()), T.StructField("slice", T.LongType()),
        T.StructField("block", T.LongType()), T.StructField("item", T.BooleanType()),
        T.StructField("text", T.StringType())])
    limit = BLOCK_CHARS

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = TaskContext.get().partitionId()
        block, group, texts, size = 0, None, [], 0
        for pdf in batches:
            done = []
            heads = list(zip(*[pdf[k] for k in keys], pdf["part"], pdf["item"]))
            for head, text in zip(heads, pdf["text"]):
                if texts and (head != group or size > limit):
                    done.append((*group[:-1], here, block, group[-1], "".join(texts)))
                    block, texts, size = block + 1, [], 0
                group = head
                text = "," + text if head[-1] else text
                texts.append(text)
                size += len(text)
            if done:
                yield pd.DataFrame(done, columns=pack_schema.names)
        if texts:
            yield pd.DataFrame([(*group[:-1], here, block, group[-1], "".join(texts))],
                               columns=pack_schema.names)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, part, state = None, None, None
        for pdf in batches:
            done = []
            heads = list(zip(*[pdf[k] for k in keys]))
            for head, now, item, text in zip(heads, pdf["part"], pdf["item"], pdf["text"]):
                if head != group:
                    if state is not None:
                        done.append((*group, state.hexdigest()))
                    group, part, state = head, None, hashlib.sha256()
                state.update((text[1:] if item and now != part else text).encode("utf-8"))
                part = now
            if done:
                yield pd.DataFrame(done, columns=[*keys, "digest"])
        if state is not None:
            yield pd.DataFrame([(*group, state.hexdigest())], columns=[*keys, "digest"])

    chosen = fragments.select(*keys, F.col("part").cast("long").alias("part"), "ord", "item", "text")
    blocks = (chosen.repartitionByRange(*keys, "part", "ord")
              .sortWithinPartitions(*keys, "part", "ord")
              .drop("ord")
              .mapInPandas(pack, pack_schema))
    return (blocks.repartition(*keys)
            .sortWithinPartitions(*keys, "part", "slice", "block")
            .mapInPandas(digest, T.StructType(key_fields + [T.StructField("digest", T.StringType())])))


_COMBINE = {
    "sum": lambda inner, before: inner + F.coalesce(before, F.lit(0)),
    "min": lambda inner, before: F.least(inner, before),
    "max": lambda inner, before: F.greatest(inner, before),
}


def running(df: DataFrame, keys: list[str], order: list[str],
            totals: dict[str, tuple[str, str]]) -> DataFrame:
    """Running ``sum``, ``min`` or ``max`` (``name -> (how, column)``) up to each row.

    Rows that compare equal on ``order`` may come in any order among themselves.
    """
    ranged = stable(df.repartitionByRange(*keys, *order)
                    .withColumn("_slice", F.spark_partition_id()))
    inside = (Window.partitionBy(*keys, "_slice").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = ranged
    for name, (how, c) in totals.items():
        rows = rows.withColumn(f"_in_{name}", getattr(F, how)(c).over(inside))
    slices = ranged.groupBy(*keys, "_slice").agg(
        *[getattr(F, how)(c).alias(f"_of_{n}") for n, (how, c) in totals.items()])
    before = (Window.partitionBy(*keys).orderBy("_slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select(*keys, "_slice", *[
        getattr(F, how)(f"_of_{n}").over(before).alias(f"_before_{n}")
        for n, (how, _) in totals.items()])
    out = rows.join(slices, [*keys, "_slice"])
    for name, (how, _) in totals.items():
        out = out.withColumn(name, _COMBINE[how](F.col(f"_in_{name}"), F.col(f"_before_{name}")))
    return out.drop("_slice", *[f"_in_{n}" for n in totals], *[f"_before_{n}" for n in totals])
