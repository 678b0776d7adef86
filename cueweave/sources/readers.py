"""Scans of saved documents, run results, dictionaries, snapshots and images."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import digests, geometry as geo, text as tx


def scan_projects(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per saved document, either version, with the file it came from; with ``lines`` each line is a document."""
    return (
        spark.read.schema(schemas.PROJECT).json(path, multiLine=not lines)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


def explode_subtitles(projects: DataFrame, keys: Sequence[str], legacy_line_id: str, subtitles: str = "subtitles") -> DataFrame:
    """One row per caption; a missing or empty line id becomes the caller's legacy id."""
    rows = projects.select(*keys, F.inline(subtitles))
    return rows.withColumn("line_id", F.coalesce(F.nullif("line_id", F.lit("")), F.lit(legacy_line_id)))


def keep_equal(df: DataFrame, **values) -> DataFrame:
    """Rows whose named columns equal the given values; the filters reach the scan."""
    return reduce(lambda acc, item: acc.filter(F.col(item[0]) == item[1]), values.items(), df)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def missing(listed: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return listed.join(present.select(*keys), list(keys), "left_anti")


def union_roles(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def explode_nested(df: DataFrame, keys: Sequence[str], outer: str, inner: str, outer_index: str, inner_name: str) -> DataFrame:
    """Array of structs that hold an array: one row per inner element with the outer position."""
    first = df.select(*keys, F.posexplode(outer).alias(outer_index, "outer"))
    return first.select(*keys, outer_index, "outer", F.explode(F.col("outer")[inner]).alias(inner_name))


# --- run results ---------------------------------------------------------------------------


def canonical_bytes(value: object) -> bytes:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()


def _result_checksum(content: pd.Series) -> pd.Series:
    """Digest of each stored document as it is, without its own ``checksum``; null if it is no JSON object."""

    def one(raw: bytes) -> str | None:
        try:
            body = json.loads(raw)
        except ValueError:
            return None
        if not isinstance(body, dict):
            return None
        return hashlib.sha256(canonical_bytes({k: v for k, v in body.items() if k != "checksum"})).hexdigest()

    return content.map(one)


def scan_results(spark: SparkSession, folder: str) -> DataFrame:
    """Run outputs of every experiment folder with their route and integrity flags.

    ``route`` is ``warmup`` for warm-up calls, ``skipped`` for files without a job, else
    ``result``. ``intact`` tells whether the stored checksum fits the whole document, fields that
    no schema names included; ``result_copies`` counts rows of the same result id.
    """
    checksum = F.pandas_udf(_result_checksum, "string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    raw = files.select(
        F.from_json(F.col("content").cast("string"), spark.createDataFrame([], schemas.RESULT).schema).alias("r"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"), checksum("content").alias("_sha"),
    ).select("r.*", "file_name", "_sha")
    route = (
        F.when(F.startswith("file_name", F.lit("warmup-")), "warmup")
        .when(F.col("job").isNull(), "skipped").otherwise("result")
    )
    identity = raw.schema["identity"].dataType
    job = raw.schema["job"].dataType
    rows = (
        raw.withColumn("route", route)
        .withColumn("intact", F.coalesce(F.col("checksum") == F.col("_sha"), F.lit(False))).drop("_sha")
        .withColumn("experiment", digests.canonical_digest(F.col("identity"), identity))
        .withColumn("job_sha", digests.canonical_digest(F.col("job"), job))
    )
    rows = rows.withColumn("result_id", digests.list_digest(F.col("experiment"), F.col("job_sha")))
    copies = rows.filter("route = 'result'").groupBy("result_id").agg(F.count(F.lit(1)).alias("result_copies"))
    return rows.join(copies, "result_id", "left")


def result_rows(scanned: DataFrame) -> DataFrame:
    """Flat rows of the usable results."""
    message = F.col("response.message")
    return scanned.filter("route = 'result' and intact").select(
        "result_id", "experiment", F.col("identity")["model"].alias("model"), "job.*", "status",
        F.coalesce(message["content"], F.lit("")).alias("output"),
        F.coalesce(message["thinking"], F.lit("")).alias("thinking"),
        "wall_ms", "response", "errors",
    )


def result_violations(scanned: DataFrame) -> DataFrame:
    bad = F.when(~F.col("intact"), "result.checksum").when(F.col("result_copies") > 1, "result.again")
    return scanned.filter("route = 'result'").select("file_name", "result_id", bad.alias("violation")).filter("violation is not null")


def scan_details_csv(spark: SparkSession, path: str, engine: str = "paddleocr", preprocessing: str = "contrast") -> DataFrame:
    """Per-record CSV (with or without byte order mark), one engine and preprocessing."""
    rows = spark.read.schema(schemas.DETAILS).csv(path, header=True, multiLine=True, quote='"', escape='"')
    return keep_equal(rows, engine=engine, preprocessing=preprocessing)


# --- dictionary ----------------------------------------------------------------------------


def _canonical_file_digest(content: pd.Series) -> pd.Series:
    def one(raw: bytes) -> str:
        return hashlib.sha256(canonical_bytes(json.loads(raw))).hexdigest()

    return content.map(one)


def file_digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Digest of the canonical JSON of each file; key order and spacing do not matter."""
    digest = F.pandas_udf(_canonical_file_digest, "string")
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), digest("content").alias("sha256"))


class Dictionary:
    """The tables of a bilingual dictionary as its manifest lists them."""

    def __init__(self, entries: DataFrame, aliases: DataFrame, sources: DataFrame, files: DataFrame, version: str):
        self.entries, self.aliases, self.sources, self.files, self.version = entries, aliases, sources, files, version


def _inside(base: str, path: str) -> str:
    """Path of a manifest file, refused when it leaves the base folder."""
    parts = PurePosixPath(path).parts
    if PurePosixPath(path).is_absolute() or ".." in parts:
        raise ValueError(f"outside the dictionary folder: {path}")
    return f"{base}/{path}"


def scan_dictionary(spark: SparkSession, manifest_path: str) -> Dictionary:
    """Read the files of a manifest by role; ``files`` tells which digest differs."""
    base = manifest_path.rsplit("/", 1)[0]
    manifest = json.loads(spark.read.text(manifest_path, wholetext=True).first()[0])
    items = [manifest["official_file"], manifest["sources_file"], *manifest["alias_files"], *manifest["term_files"]]
    roles: dict[str, list[str]] = {}
    for item in items:
        roles.setdefault(item["role"], []).append(_inside(base, item["path"]))

    def read(role: str, shape: str) -> DataFrame:
        return spark.read.schema(shape).json(roles.get(role, []), multiLine=True).withColumn("file_name", F.col("_metadata.file_name"))

    entry = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in schemas.ENTRY.split(', '))}>>"
    alias_type = spark.createDataFrame([], schemas.ALIAS).schema.simpleString()
    official = read("official", f"entries {entry}").select(F.inline("entries"), "file_name").withColumn("origin", F.lit("official"))
    terms = read("terms", f"concepts {entry}, aliases array<{alias_type}>")
    concepts = terms.select(F.inline("concepts"), "file_name").withColumn("origin", F.lit("curated_concept"))
    aliases = union_roles([
        read("aliases", f"aliases array<{alias_type}>").select(F.inline("aliases"), "file_name"),
        terms.select(F.inline("aliases"), "file_name"),
    ])
    sources = read("sources", "sources map<string,struct<url:string,kind:string>>").select(
        F.explode("sources").alias("id", "source"), "file_name"
    ).select("id", "source.*", "file_name")
    listed = spark.createDataFrame(
        [(i["role"], i["path"], i["sha256"], i.get("expected_count", i.get("expected_alias_count")), i.get("expected_concept_count"), i.get("target_category")) for i in items],
        "role string, file_name string, expected_sha256 string, expected_count int, expected_concept_count int, target_category string",
    )
    actual = file_digests(spark, [p for paths in roles.values() for p in paths])
    files = listed.join(actual, "file_name", "left").withColumn("intact", F.col("sha256").eqNullSafe(F.col("expected_sha256")))
    return Dictionary(union_roles([official, concepts]), aliases, sources, files, manifest.get("app_dictionary_version"))


# --- locale snapshots ----------------------------------------------------------------------

_NAMED = "struct<id:string,name:string>"
_CHAMPIONS = f"data map<string,struct<name:string,passive:struct<name:string>,spells:array<{_NAMED}>>>"
_ITEMS = "data map<string,struct<name:string,maps:map<string,boolean>,gold:struct<purchasable:boolean>,inStore:boolean,requiredChampion:string,specialRecipe:string>>"
_SPELLS = "data map<string,struct<name:string,modes:array<string>>>"
_TREES = f"id string, name string, slots array<struct<runes:array<{_NAMED}>>>"
# The four active slots and the map whose items are kept.
SLOTS = ("Q", "W", "E", "R")
MAP_ID = "11"


def scan_locale_snapshot(spark: SparkSession, folder: str, locale: str) -> DataFrame:
    """Long rows of one locale: category, id, name and the keys that place an entry."""
    at = f"{folder}/{locale}"
    none = F.lit(None).cast("string")

    def row(category: str, identifier: Column, name: Column, owner: Column = none, slot: Column = none) -> list[Column]:
        return [
            F.lit(category).alias("category"), identifier.alias("id"), tx.clean_name(name).alias("name"),
            owner.alias("champion_id"), slot.alias("slot"), F.lit(locale).alias("locale"),
        ]

    who = spark.read.schema(_CHAMPIONS).json(f"{at}/champion", multiLine=True).select(F.explode("data").alias("key", "v"))
    champions = who.select(*row("champion", F.concat(F.lit("champion:"), F.col("key")), F.col("v.name")))
    passives = who.select(*row("champion_ability", F.concat(F.lit("ability:"), F.col("key"), F.lit(":P")), F.col("v.passive.name"), F.col("key"), F.lit("P")))
    spells = who.filter(F.size("v.spells") == len(SLOTS)).select("key", F.posexplode("v.spells").alias("at", "spell"))
    slot = F.element_at(F.array(*[F.lit(s) for s in SLOTS]), F.col("at") + 1)
    actives = spells.select(*row("champion_ability", F.concat_ws(":", F.lit("ability"), F.col("key"), slot), F.col("spell.name"), F.col("key"), slot))
    items = (
        spark.read.schema(_ITEMS).json(f"{at}/item.json", multiLine=True).select(F.explode("data").alias("key", "v"))
        .filter(F.coalesce(F.col("v.maps")[MAP_ID], F.lit(False)))
        .select(*row("item", F.concat(F.lit("item:"), F.col("key")), F.col("v.name")))
    )
    trees = spark.read.schema(_TREES).json(f"{at}/runesReforged.json", multiLine=True)
    roots = trees.select(*row("rune_tree", F.concat(F.lit("rune-tree:"), F.col("id")), F.col("name")))
    runes = (
        trees.select(F.explode("slots").alias("s")).select(F.explode("s.runes").alias("r"))
        .select(*row("rune", F.concat(F.lit("rune:"), F.col("r.id")), F.col("r.name")))
    )
    summoner = (
        spark.read.schema(_SPELLS).json(f"{at}/summoner.json", multiLine=True).select(F.explode("data").alias("key", "v"))
        .select(*row("summoner_spell", F.concat(F.lit("summoner-spell:"), F.col("key")), F.col("v.name")))
    )
    return reduce(DataFrame.unionByName, [champions, passives, actives, items, roots, runes, summoner])


def incomplete_spells(spark: SparkSession, folder: str, locale: str) -> DataFrame:
    """Owners that do not list exactly four spells."""
    who = spark.read.schema(_CHAMPIONS).json(f"{folder}/{locale}/champion", multiLine=True).select(F.explode("data").alias("key", "v"))
    return who.filter(~F.coalesce(F.size("v.spells") == len(SLOTS), F.lit(False))).select("key", F.size("v.spells").alias("spells"))


# --- line specifications -------------------------------------------------------------------


def expand_lines(samples: DataFrame) -> DataFrame:
    """Three frames of every line of a video specification, the middle one primary.

    ``samples`` has id, time, fps, correction, speech and annotation (null: speech only). With an
    annotation there is a row per role, the whole crop being diagnostic only.
    """
    both = F.col("annotation").isNotNull()
    whole = F.concat_ws("\n", "annotation", "speech")

    def role(name: str, order: Column, text: Column) -> Column:
        return F.struct(F.lit(name).alias("line_role"), order.cast("int").alias("reading_order"), text.alias("source_ko"))

    speech = role("speech", F.when(both, 2).otherwise(1), F.col("speech"))
    roles = F.when(both, F.array(role("annotation", F.lit(1), F.col("annotation")), speech, role("whole", F.lit(None), whole))).otherwise(F.array(speech))
    at = F.col("time") + F.coalesce("correction", F.lit(0.0))
    rows = samples.withColumn("r", F.explode(roles)).withColumn("f", F.explode(geo.frame_offsets(at, F.col("fps"))))
    kept = [c for c in samples.columns if c not in ("id", "time", "fps", "correction", "speech", "annotation")]
    return rows.select(
        F.format_string("%s_%s_f%02d", F.col("id").cast("string"), "r.line_role", "f.frame").alias("id"), F.col("id").alias("group_id"),
        F.col("f.ts").alias("timestamp_seconds"), F.col("f.primary").alias("primary"), "r.line_role", "r.reading_order", "r.source_ko",
        (F.col("r.line_role") == "whole").alias("diagnostic_only"), *kept,
    )


# --- images --------------------------------------------------------------------------------


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with the digest of their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("image_file"), F.sha2("content", 256).alias("sha256"), "length", "content"
    )


def image_violations(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Files that a manifest lists but the folder lacks, or whose bytes differ."""
    both = manifest.select("id", "image_file", F.col("image_sha256").alias("_want")).join(
        images.select("image_file", F.col("sha256").alias("_have")), "image_file", "left"
    )
    found = F.when(F.col("_have").isNull(), "file.missing").when(F.col("_want") != F.col("_have"), "file.digest")
    return both.select("id", "image_file", found.alias("violation")).filter("violation is not null")
