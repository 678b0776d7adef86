"""Rows that operators must survive: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for themselves.
CLASHING = ["_file", "_row", "norm", "digest", "first", "n", "set", "check", "sig", "row", "id", "label", "kept", "whole", "spans", "host", "salt"]


def words(rng: random.Random, n: int, vocabulary: int = 500) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *("en", "s1")[len(r) - 2 :], None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, None, None, None), (2, "", "en", "s1"), (3, " \n\t ", "en", "s1"), (4, "one", "en", None), (4, "one", "en", None), (None, "one", "en", "s2"),
        (5, long, "en", "s1"), (6, long, "en", "s1"), (7, "a" * 50_000, "en", "s3"), (8, "1 " * 5_000, "en", "s3"), (9, "¡é𝄞 ß x", "fr", "s1"),
    ]
    return documents(spark, rows)


def clashing(spark, rows):
    """Documents with an extra column of each name in ``CLASHING``."""
    from pyspark.sql import functions as F

    return documents(spark, rows).select("*", *[F.lit(name).alias(name) for name in CLASHING])


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
