"""Checks that return violations as rows: (key columns, rule)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions import geometry as geo
from .ordered import sequence_of

SHA256 = "^[0-9a-f]{64}$"
# Bounds of a request.
INTERVAL_MS = (50, 5_000)
DURATION_MS = (0, 60_000)
SPLIT_RATIO = (0.1, 0.9)
LEGACY_DURATION_MS = 1_200
VERSIONS = (1, 2)
ACTIVE_STATUSES = ("source_checked", "community_source_checked", "official_derived")


def violations(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per broken rule; a rule that is null counts as not broken."""
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return df.select(*keys, F.explode(found).alias("violation"))


def _empty(c: str) -> Column:
    return F.length(F.coalesce(c, F.lit(""))) == 0


def _finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def repeated(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Flag rows whose column values occur more than once (partial count, then join back)."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*columns, F.lit(True).alias(name))
    return df.join(counts, list(columns), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def check_manifest(images: DataFrame) -> DataFrame:
    """Rules of a recognition manifest, per image."""
    many = images.groupBy("group_id").agg((F.min("ground_truth") != F.max("ground_truth")).alias("_mixed"))
    rows = repeated(repeated(images, ["id"], "_same_id"), ["image_file"], "_same_file").join(many, "group_id", "left")
    lines = F.length("ground_truth") - F.length(F.replace("ground_truth", F.lit("\n"), F.lit(""))) + 1
    tags = F.col("tags")
    return violations(rows, ["id"], {
        "image.id": _empty("id"),
        "image.id_again": F.col("_same_id"),
        "image.group": _empty("group_id"),
        "image.time": ~_finite(F.col("timestamp_seconds")) | (F.col("timestamp_seconds") < 0),
        "image.file": _empty("image_file") | F.col("image_file").rlike(r"[/\\]"),
        "image.file_again": F.col("_same_file"),
        "image.truth": _empty("ground_truth"),
        "image.status": ~F.col("ground_truth_status").eqNullSafe("verified"),
        "image.lines": ~F.col("line_count").eqNullSafe(lines),
        "image.tags": tags.isNull() | (F.size(tags) == 0)
        | F.exists(tags, lambda t: t.isNull() | (t == "")) | (F.size(F.array_distinct(tags)) != F.size(tags)),
        "image.group_truth": F.col("_mixed"),
    })


def check_manifest_source(source: DataFrame) -> DataFrame:
    """Rules of a manifest's source block: id, digest, size and region."""
    r = F.col("subtitle_region")
    box = geo.region_to_pixels(r["x"], r["y"], r["width"], r["height"], F.col("width"), F.col("height"))
    return violations(source, ["video_id"], {
        "source.video": _empty("video_id"),
        "source.digest": ~F.coalesce(F.col("sha256").rlike(SHA256), F.lit(False)),
        "source.width": F.coalesce(F.col("width") <= 0, F.lit(True)),
        "source.height": F.coalesce(F.col("height") <= 0, F.lit(True)),
        "source.region": box.isNull(),
    })


COMPARED = ("group_id", "timestamp_seconds", "tags", "line_count", "ground_truth")


def check_results(results: DataFrame, manifest: DataFrame, compared: Sequence[str] = COMPARED) -> DataFrame:
    """Result rows against manifest rows at the same ``ordinal``: ids, order and five fields."""
    want = manifest.select("ordinal", F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in compared])
    both = results.join(want, "ordinal", "full_outer")
    present = F.col("_id").isNotNull() & F.col("image_id").isNotNull()
    rules = {"result.order": ~F.col("_id").eqNullSafe(F.col("image_id"))}
    for c in compared:
        rules[f"result.{c}"] = present & (F.col("_id") == F.col("image_id")) & ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return violations(both, ["ordinal"], rules)


def check_result_sets(runs: DataFrame, manifest_digest: str) -> DataFrame:
    """One row per result file: digest of the manifest it was made from, and repeated settings."""
    return violations(repeated(runs, ["engine", "preprocessing"], "_again"), ["engine", "preprocessing"], {
        "run.manifest": ~F.col("manifest_sha256").eqNullSafe(manifest_digest),
        "run.again": F.col("_again"),
    })


def check_project(captions: DataFrame, video: str = "video_id", target_rows: int | None = None) -> DataFrame:
    """Captions of saved documents (start/end may not fall back within a line).

    ``ordinal`` is the place of a caption in its document.
    """
    line = F.coalesce("line_id", F.lit("line-1"))
    rows = repeated(captions.withColumn("_line", line), [video, "id"], "_same_id")
    seq = sequence_of(rows, [video, "_line"], ["ordinal"], target_rows).previous(_end_before=F.col("end_seconds")).done()
    start, end = F.col("start_seconds"), F.col("end_seconds")
    before = F.coalesce("_end_before", F.lit(-1.0))
    second = F.coalesce(F.col("schema_version") == 2, F.lit(False)) if "schema_version" in captions.columns else F.lit(True)
    return violations(seq, [video, "id"], {
        "caption.id": _empty("id") | F.col("_same_id"),
        "caption.line": second & (_empty("line_id") | F.coalesce(F.col("line_index") < 0, F.lit(True))),
        "caption.order": ~_finite(start) | ~_finite(end) | (start < before) | (end < start),
        "caption.raw": F.col("raw_text").isNull(),
    })


def check_document(projects: DataFrame, kind: str) -> DataFrame:
    return violations(projects, ["source_file"], {
        "document.version": ~F.coalesce(F.col("schema_version").isin(*VERSIONS), F.lit(False)) | ~F.col("kind").eqNullSafe(kind),
        "document.captions": F.col("subtitles").isNull(),
    })


def orphans(rows: DataFrame, key: str, refs: Column, known: DataFrame, known_key: str) -> DataFrame:
    """Exploded references of each row that the known table lacks."""
    exploded = rows.select(key, F.explode(refs).alias("ref"))
    return exploded.join(known.select(F.col(known_key).alias("ref")), "ref", "left_anti")


def check_dictionary(entries: DataFrame, aliases: DataFrame, sources: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Rules of an active dictionary as (id, violation)."""
    tagged = lambda df, name: df.select("id", F.lit(name).alias("violation"))
    official, concepts = entries.filter("origin = 'official'"), entries.filter("origin <> 'official'")
    twice = lambda df, what: tagged(repeated(df.select("id"), ["id"], "_again").filter("_again").distinct(), f"{what}.again")
    status = F.coalesce("status", F.lit(""))
    active = F.lit(False)
    for prefix in ACTIVE_STATUSES:
        active = active | F.startswith(status, F.lit(prefix))
    short = F.length(F.trim("ko")) < 2
    rules = violations(aliases, ["id"], {
        "alias.status": ~active,
        "alias.sources": F.coalesce(F.size("sources") <= 0, F.lit(True)),
        "alias.short": short & F.col("ambiguity").isNull(),
    })
    blank = official.filter((F.trim(F.coalesce("ko", F.lit(""))) == "") | (F.trim(F.coalesce("ja", F.lit(""))) == ""))
    out = (
        rules.unionByName(twice(entries, "entry")).unionByName(twice(aliases, "alias")).unionByName(twice(concepts, "concept"))
        .unionByName(tagged(orphans(aliases, "id", F.col("sources"), sources, "id"), "alias.source_ref"))
        .unionByName(tagged(orphans(aliases, "id", F.col("target_ids"), entries, "id"), "alias.target_ref"))
        .unionByName(tagged(blank, "entry.names"))
    )
    if files is not None:
        wanted = aliases.join(files.filter("target_category is not null").select("file_name", "target_category"), "file_name")
        targets = wanted.select("id", "target_category", F.explode("target_ids").alias("ref")).join(
            entries.select(F.col("id").alias("ref"), "category"), "ref"
        )
        wrong = targets.filter("category <> target_category").select("id").distinct()
        out = out.unionByName(tagged(wrong, "alias.category"))
    return out


# How page sources are marked and what they must tell.
PAGE_KIND, PAGE_PREFIX = "namu_wiki", "namu_"
PAGE_SOURCE_FIELDS = ("url", "retrieval_url", "section", "checked_at", "page_revision")


def check_page_sources(sources: DataFrame) -> DataFrame:
    """Page sources must name where and when they were read."""
    missing = F.lit(False)
    for c in PAGE_SOURCE_FIELDS:
        missing = missing | (F.col(c).isNull() if c in sources.columns else F.lit(True))
    return violations(sources.filter(F.col("kind") == PAGE_KIND), ["id"], {"page.source": missing})


def check_page_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases from pages are source checked, not yet human checked, and carry evidence."""
    paged = aliases.filter(F.exists("sources", lambda s: F.startswith(s, F.lit(PAGE_PREFIX))))
    v = F.col("verification")
    return violations(paged, ["id"], {
        "page.checked": ~F.coalesce(v["source_checked"], F.lit(False)) | F.coalesce(v["human_checked"], F.lit(False)),
        "page.evidence": _empty("evidence"),
    })


def check_request(requests: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Rules of an analysis request; unknown fields show up as the schema drops them."""
    r, a, s = F.col("subtitle_region"), F.col("analysis_range"), F.col("settings")
    ranged = a["mode"] == "range"
    start, end = a["start_seconds"], a["end_seconds"]
    bad_range = ~_finite(start) | ~_finite(end) | (start < 0) | (end <= start)
    legacy = F.col("schema_version") == 1
    duration = F.when(legacy, F.coalesce(s["minimum_display_duration_ms"], F.lit(LEGACY_DURATION_MS))).otherwise(s["minimum_display_duration_ms"])
    outside = lambda c, bounds: ~F.coalesce(c.between(*bounds), F.lit(False))
    split = s["line_split_ratio"]
    return violations(requests, list(keys), {
        "request.version": ~F.coalesce(F.col("schema_version").isin(*VERSIONS), F.lit(False)),
        "request.path": F.trim(F.coalesce("video_path", F.lit(""))) == "",
        "request.path_relative": ~F.coalesce(F.col("video_path").rlike(r"^(/|[A-Za-z]:[\\/])"), F.lit(False)),
        "request.region": ~F.coalesce(geo.region_valid(r["x"], r["y"], r["width"], r["height"]), F.lit(False)),
        "request.mode": ~F.coalesce(a["mode"].isin("range", "whole"), F.lit(False)),
        "request.bounds": F.coalesce(ranged, F.lit(False)) & bad_range,
        "request.bounds_unused": F.coalesce(a["mode"] == "whole", F.lit(False)) & (start.isNotNull() | end.isNotNull()),
        "request.interval": outside(s["sample_interval_ms"], INTERVAL_MS),
        "request.split": split.isNotNull() & outside(split, SPLIT_RATIO),
        "request.duration": outside(duration, DURATION_MS),
    })


def unknown_fields(raw: DataFrame, column: str, expected: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Fields of a raw JSON object that are not expected, and expected ones that it lacks."""
    have = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    want = F.array(*[F.lit(c) for c in expected])
    return raw.select(*keys, F.array_except(have, want).alias("unknown"), F.array_except(want, have).alias("missing")).filter(
        (F.size("unknown") > 0) | (F.size("missing") > 0)
    )


def parse_judgement(answers: DataFrame, response: str, expected: str) -> DataFrame:
    """Parse judge answers; ``problem`` tells why an answer cannot be used.

    ``expected`` is the column with the candidate ids that the answer must judge, as a set.
    """
    parsed = answers.withColumn("judgement", F.from_json(response, schemas.JUDGEMENT))
    rows = F.col("judgement.judgements")
    got = F.array_sort(F.array_distinct(F.transform(rows, lambda j: j["candidate_id"])))
    blank = lambda c: F.length(F.coalesce(c, F.lit(""))) == 0
    silent = F.exists(rows, lambda j: blank(j["rationale"]) | blank(j["semantic_signature"]))
    problem = (
        F.when(rows.isNull() | ~got.eqNullSafe(F.array_sort(F.array_distinct(expected))), "answer.candidates")
        .when(silent, "answer.silent")
    )
    return parsed.withColumn("problem", problem)


def judged_outputs(parsed: DataFrame, candidates: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Usable judgements joined back to the outputs they are about."""
    rows = parsed.filter("problem is null").select(sample, F.inline("judgement.judgements"))
    return candidates.join(rows, [sample, "candidate_id"])
