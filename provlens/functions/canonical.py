"""Canonical JSON (sorted keys, no blanks, least escapes) and hashes over it.

Everything here is a native column expression built from the column's type; records
of plain fields stay inside code generation, lists and maps use higher-order
functions. ``jcs_any`` is the exception: it canonicalises JSON text whose shape is
not known beforehand, in Arrow batches.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlens import schemas

_SPECIAL = r'[\x00-\x1f"\\]'
# Spark writes nine control characters with capital hex digits; canonical text has
# small ones. An escape is told from an escaped backslash before "u" by the even
# number of backslashes in front of it.
_CAPITALISED = r"[\x0b\x0e\x0f\x1a-\x1f]"
_ESCAPE_ENDING_IN = r"(?<!\\)((?:\\\\)*\\u00[01])"


def sha256_hex(col: Column) -> Column:
    return F.sha2(col, 256)


def json_text(col: Column) -> Column:
    """A JSON string literal; most values need no escape and take the first branch."""
    written = F.to_json(F.struct(col.alias("v")))
    written = F.substring(written, F.lit(6), F.length(written) - 6)
    small = reduce(lambda text, d: F.regexp_replace(text, _ESCAPE_ENDING_IN + d, "$1" + d.lower()), "ABCDEF", written)
    return (F.when(col.isNull(), F.lit(None).cast("string"))
            .when(~col.rlike(_SPECIAL), F.concat(F.lit('"'), col, F.lit('"')))
            .when(~col.rlike(_CAPITALISED), written)
            .otherwise(small))


def _utf16(name: str) -> bytes:
    return name.encode("utf-16-be")


def _literal(name: str) -> str:
    return json.dumps(name, ensure_ascii=False)


def canonical(col: Column, dtype: T.DataType) -> Column:
    """Canonical text of ``col``; floats, decimals and bytes are refused."""
    if isinstance(dtype, T.StringType):
        text = json_text(col)
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        text = col.cast("string")
    elif isinstance(dtype, T.TimestampType):
        text = json_text(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    elif isinstance(dtype, T.DateType):
        text = json_text(F.date_format(col, "yyyy-MM-dd"))
    elif isinstance(dtype, T.NullType):
        return F.lit("null")
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(col, lambda x: canonical(x, dtype.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        # Keys sort by UTF-16 code unit, which differs from UTF-8 beyond the BMP.
        entries = F.array_sort(F.transform(
            F.map_entries(col),
            lambda e: F.struct(F.encode(e["key"], "UTF-16BE").alias("order"),
                               e["key"].alias("key"),
                               canonical(e["value"], dtype.valueType).alias("text"))))
        pairs = F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["text"]))
        text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(dtype, T.StructType):
        text = canonical_struct({f.name: (col[f.name], f.dataType) for f in dtype.fields})
        return F.when(col.isNull(), F.lit("null")).otherwise(text)
    else:
        raise TypeError(f"{dtype.simpleString()} has no canonical form; cast it to string or long")
    return F.coalesce(text, F.lit("null"))


def canonical_struct(fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    """Canonical text of an object given as ``name -> (column, type)``."""
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields, key=_utf16)):
        col, dtype = fields[name]
        parts += [F.lit(("," if i else "{") + _literal(name) + ":"), canonical(col, dtype)]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def _fields(df: DataFrame, names: list[str]) -> dict[str, tuple[Column, T.DataType]]:
    return {n: (F.col(n), df.schema[n].dataType) for n in names}


def hash_object(df: DataFrame, names: list[str]) -> Column:
    """Digest of the canonical object made of the named columns of ``df``."""
    return sha256_hex(canonical_struct(_fields(df, names)))


def self_hash(df: DataFrame, kind: str) -> Column:
    """Digest of an artifact record without its own hash column."""
    schema, own = schemas.ARTIFACTS[kind]
    return hash_object(df, [f.name for f in schema.fields if f.name != own])


def entry_hash(df: DataFrame) -> Column:
    """Digest of an audit entry without ``entry_hash``."""
    return hash_object(df, [f.name for f in schemas.AUDIT_ENTRY.fields if f.name != "entry_hash"])


def _rewrite(value: object) -> str:
    if isinstance(value, float):
        raise TypeError("float")
    if isinstance(value, dict):
        keys = sorted(value, key=_utf16)
        return "{" + ",".join(_literal(k) + ":" + _rewrite(value[k]) for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_rewrite, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _canonical_or_none(text: str | None) -> str | None:
    try:
        return None if text is None else _rewrite(json.loads(text))
    except (ValueError, TypeError):
        return None


@F.pandas_udf(T.StringType())
def jcs_any(texts: pd.Series) -> pd.Series:
    """Canonical form of arbitrary JSON text; null where it has none."""
    return texts.map(_canonical_or_none)
