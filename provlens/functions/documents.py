"""Digests of records whose lists are too long for one row.

A record is given as a nested dict: a Column is canonical text, a DataFrame is a
list in long form (``keys, ord, text``), a dict is an object. The text of the
whole record is never built; only its digest is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens.functions.ordered import document_digest
from provlens.session import stable


def items(df: DataFrame, keys: list[str], ord: Column, text: Column) -> DataFrame:
    return df.select(*keys, ord.alias("ord"), text.alias("text"))


def _segments(record: dict) -> list:
    out: list = []
    for i, name in enumerate(sorted(record)):
        value = record[name]
        out.append(F.lit(("," if i else "{") + f'"{name}":'))
        if isinstance(value, dict):
            out += _segments(value)
        elif isinstance(value, DataFrame):
            out += [F.lit("["), value, F.lit("]")]
        else:
            out.append(value)
    return out + [F.lit("}")]


def segments_digest(headers: DataFrame, keys: list[str], segments: list, name: str) -> DataFrame:
    """``headers`` plus the digest of text (Columns) and lists (DataFrames) put end to end.

    Headers are written out first: they give the fixed text of every section in one
    pass and are joined with the digests afterwards.
    """
    headers = stable(headers)
    lists: list[DataFrame] = []
    fixed: list[Column] = []
    part, texts = 0, []

    def flush() -> None:
        nonlocal part, texts
        if texts:
            fixed.append(F.struct(F.lit(part).cast("long").alias("part"), F.concat(*texts).alias("text")))
            part, texts = part + 1, []

    for segment in segments:
        if isinstance(segment, DataFrame):
            flush()
            lists.append(segment.select(*keys, F.lit(part).cast("long").alias("part"), "ord",
                                        F.lit(True).alias("item"), "text"))
            part += 1
        else:
            texts.append(segment)
    flush()
    scaffold = headers.select(*keys, F.explode(F.array(*fixed)).alias("f")).select(
        *keys, "f.part", F.lit("").alias("ord"), F.lit(False).alias("item"), "f.text")
    digests = document_digest(reduce(DataFrame.unionByName, lists, scaffold), keys)
    return headers.join(digests.withColumnRenamed("digest", name), keys)


def record_digest(headers: DataFrame, keys: list[str], record: dict, name: str) -> DataFrame:
    """``headers`` plus the digest of each key's record in column ``name``."""
    return segments_digest(headers, keys, _segments(record), name)
