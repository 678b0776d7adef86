"""Registry of driver queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship_package

# Letters beyond ASCII of the driver's texts, each as one control character: SQL distances count bytes, ours code points.
LETTERS = "ßäöüéèêçñíóÄÖÜÉÈÊÇÑÍÓ"
CODES = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 28)][: len(LETTERS)])
TEXT = f"translate(text, '{LETTERS}', {CODES})"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Fixed value: the whitespace class in RE2 syntax.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(name: str, sql: str | None = None):
    """Register a query; ``{WS}`` in the SQL is the whitespace class, ``{TEXT}`` the text with one byte per letter."""

    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql.replace("{WS}", WS).replace("{TEXT}", TEXT)
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship_package(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp column."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def pick(**columns: Column) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]
