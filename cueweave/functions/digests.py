"""Stable digests and identifiers built from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def _canonical(value: Column, kind: T.DataType) -> Column:
    """Rebuild a value with struct fields and map entries in sorted order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        built = F.struct(*[_canonical(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), built)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _canonical(item, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        return F.map_from_entries(
            F.transform(entries, lambda e: F.struct(e["key"], _canonical(e["value"], kind.valueType)))
        )
    return value


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """Compact JSON with sorted keys and explicit nulls. ``kind`` is the type of ``value``."""
    return F.to_json(_canonical(value, kind), {"ignoreNullFields": "false"})


def canonical_digest(value: Column, kind: T.DataType) -> Column:
    return F.sha2(canonical_json(value, kind), 256)


def _json_string(c: Column) -> Column:
    """One JSON string literal, quotes included."""
    wrapped = F.to_json(F.struct(c.cast("string").alias("v")))
    return wrapped.substr(F.lit(6), F.length(wrapped) - 6)


def list_digest(*parts: Column) -> Column:
    """Digest of a JSON list of strings."""
    body = F.concat_ws(",", *[_json_string(p) for p in parts])
    return F.sha2(F.concat(F.lit("["), body, F.lit("]")), 256)


def blind_id(result_id: Column) -> Column:
    """Identifier that hides the result it stands for."""
    return F.concat(F.lit("review-"), F.substring(list_digest(F.lit("blind-v1"), result_id), 1, 16))


def candidate_id(sample_id: Column, output: Column) -> Column:
    return F.concat(F.lit("candidate-"), F.substring(list_digest(sample_id, output), 1, 12))
