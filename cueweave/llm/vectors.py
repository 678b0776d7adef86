"""Vectors that take part, their copies, and joining results per different vector back to the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: A vector with more than one in so many of all rows is joined by broadcast; there are fewer than so many of them.
FEW = 1000


def usable(vector: Column) -> Column:
    """Whether a vector has entries, none of them null, infinite or not a number."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def dimension(rows: DataFrame, vector: str) -> int:
    """The most frequent length, the longer of two as frequent; 0 without rows."""
    sizes = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return sizes.d if sizes else 0


def joined_back(rows: DataFrame, table: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """``rows`` joined to ``table``, which has one row per ``key`` and the number of its ``copies`` among ``total`` rows.

    Frequent keys, fewer than ``FEW`` whatever the input holds, are broadcast, so no task gets all rows of one.
    """
    hot = stored(table.filter(F.col(copies) * FEW > total), "frequent")
    known = F.broadcast(hot)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col(copies) * FEW <= total), key)
    return rows.join(known, key).unionByName(cold)
