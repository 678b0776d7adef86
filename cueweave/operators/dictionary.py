"""Dictionary build, diff, audit and manifest refresh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import digests, text as tx


def pair_locales(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("category", "id")) -> DataFrame:
    """Names of two locales side by side; ``problem`` tells what keeps a row from being an entry."""
    keys = list(keys)
    extra = [c for c in left.columns if c not in (*keys, "name", "locale")]
    a = left.select(*keys, *extra, F.col("name").alias("ko"), F.lit(True).alias("_a"))
    b = right.select(*keys, F.col("name").alias("ja"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    problem = (
        F.when(F.col("_a").isNull(), "missing_ko").when(F.col("_b").isNull(), "missing_ja")
        .when(tx.is_blank("ko") | tx.is_blank("ja"), "empty_name")
    )
    return both.withColumn("problem", problem).drop("_a", "_b")


def official_entries(paired: DataFrame) -> DataFrame:
    """Entries of a paired snapshot that have no problem."""
    return paired.filter("problem is null").drop("problem").withColumn("origin", F.lit("official"))


def version_diff(previous: DataFrame, current: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Added, removed and renamed ids with the values before and after."""
    a = previous.select(key, F.struct(*values).alias("before"))
    b = current.select(key, F.struct(*values).alias("after"))
    both = a.join(b, key, "full_outer")
    change = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "renamed")
    )
    return both.withColumn("change", change).filter("change is not null")


def ledger_mismatch(candidates: DataFrame, active: DataFrame, on: Sequence[str], must: Column, must_not: Column) -> DataFrame:
    """Candidates that should be active but are not, or are active but should not be."""
    on = list(on)
    known = active.select(*on).distinct()
    absent = candidates.filter(must).join(known, on, "left_anti").withColumn("problem", F.lit("missing_confirmed"))
    wrong = candidates.filter(must_not).join(known, on, "left_semi").withColumn("problem", F.lit("forbidden_active"))
    return absent.unionByName(wrong)


def survey_mismatch(survey: DataFrame, aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """The first survey: decided by term alone."""
    active = aliases.select(F.col("ko").alias("term")).union(concepts.select("ko"))
    decision = F.col("decision")
    rejected = decision.startswith("unconfirmed") | decision.startswith("rejected")
    return ledger_mismatch(survey, active, ["term"], decision.contains("active"), rejected)


def page_survey_mismatch(candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """The page survey: decided by term and target list together."""
    active = aliases.select(F.col("ko").alias("term"), "target_ids")
    decision = F.col("decision")
    return ledger_mismatch(candidates, active, ["term", "target_ids"], decision.isin("added_active", "duplicate_existing"), decision == "held_unconfirmed")


def incomplete_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(~F.col("collection_status").eqNullSafe("complete"))


def collision_report(records: DataFrame) -> DataFrame:
    """Terms that lead to more than one distinct target, with the targets sorted."""
    named = records.select(tx.dictionary_key("term").alias("term"), F.explode("target_ids").alias("target")).distinct()
    return named.groupBy("term").agg(F.array_sort(F.collect_set("target")).alias("target_ids")).filter(F.size("target_ids") > 1)


def collision_sources(records: DataFrame) -> DataFrame:
    """The records behind each colliding term, one row each."""
    named = records.select(tx.dictionary_key("term").alias("term"), "source_id")
    return named.join(collision_report(records).select("term"), "term").distinct()


def counts_by(df: DataFrame, column: Column, name: str = "key") -> DataFrame:
    return df.groupBy(column.cast("string").alias(name)).agg(F.count(F.lit(1)).alias("actual_count"))


def dictionary_counts(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Counts by category and status, and of aliases with a condition or a history."""
    tag = lambda df, what: df.select(F.lit(what).alias("what"), "key", "actual_count")
    targeted = aliases.select(F.explode("target_ids").alias("id")).join(entries.select("id", "category"), "id")
    marks = aliases.agg(
        F.count_if(F.col("ambiguity").isNotNull()).alias("context_required"), F.count_if(F.col("historical").isNotNull()).alias("historical")
    ).select(F.expr("stack(2, 'context_required', context_required, 'historical', historical) as (key, actual_count)"))
    parts = [
        tag(counts_by(entries.filter("origin = 'official'"), F.col("category")), "official"),
        tag(counts_by(targeted, F.col("category")), "alias_category"),
        tag(counts_by(aliases, F.col("status")), "alias_status"),
        tag(marks, "alias"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def count_differences(actual: DataFrame, expected: DataFrame, key: str = "key") -> DataFrame:
    """Keys whose expected count differs; a key absent on one side counts as zero."""
    both = actual.join(expected, key, "full_outer").na.fill(0, ["actual_count", "expected_count"])
    return both.filter("actual_count <> expected_count")


def survey_summary(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts that the summary of a page survey must equal."""
    decision = F.col("decision")
    decided = candidates.agg(
        F.count_if(decision == "added_active").alias("added"), F.count_if(decision == "duplicate_existing").alias("duplicate_existing"),
        F.count_if(decision == "held_unconfirmed").alias("held"),
    )
    seen = pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("collection_status") == "complete").alias("completed_pages"))
    return decided.withColumn("_k", F.lit(1)).join(seen.withColumn("_k", F.lit(1)), "_k").drop("_k")


def set_digest(df: DataFrame, groups: Sequence[str], item: Column) -> DataFrame:
    """Digest of a set of rows that does not depend on their order and never gathers the set.

    The digests of the rows are summed in four exact parts, so every task adds up its own rows.
    """
    sha = F.sha2(item, 256)
    hashed = df.select(*groups, sha.alias("_h"))
    part = lambda i: F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
    sums = hashed.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), *[part(i).alias(f"_p{i}") for i in range(4)])
    body = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"_p{i}").cast("string") for i in range(4)])
    return sums.select(*groups, "rows", F.sha2(body, 256).alias("digest"))


def content_drift(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows of the baseline that the current table lacks or holds with other content."""
    body = lambda df: digests.canonical_digest(F.struct(*df.columns), df.schema)
    a = baseline.select(key, body(baseline).alias("baseline_digest"))
    b = current.select(key, body(current.select(*baseline.columns)).alias("current_digest"))
    both = a.join(b, key, "left")
    return both.filter(~F.col("baseline_digest").eqNullSafe(F.col("current_digest")))


def replay_drift(actual: DataFrame, expected: DataFrame, case: str, fields: Sequence[str]) -> DataFrame:
    """Selection cases whose traced matches differ from the recorded ones."""
    return version_diff(expected, actual, case, fields)


ROLES = ("official", "sources", "aliases", "terms")


def refresh_manifest(files: DataFrame) -> DataFrame:
    """New digest and record counts per file; ``files`` has role, file_name, sha256, kind, item_id.

    ``kind`` tells entries, sources, aliases and concepts apart. Unknown roles are marked.
    """
    counted = files.groupBy("role", "file_name", "sha256").agg(
        F.count_if(F.col("kind") == "concept").alias("expected_concept_count"),
        F.count_if((F.col("kind") != "concept") & F.col("item_id").isNotNull()).alias("expected_count"),
    )
    return counted.withColumn("problem", F.when(~F.col("role").isin(*ROLES), F.concat(F.lit("role? "), "role")))


def combined_digest(files: DataFrame, path: str = "file_name", sha: str = "sha256") -> DataFrame:
    """One digest over the sorted ``path:digest`` pairs of a dictionary's files."""
    pairs = F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", path, sha))), ":")
    return files.agg(F.sha2(pairs, 256).alias("sha256"))


def version_record(files: DataFrame, version: str, patch: str) -> DataFrame:
    """What a translation trace stores about the dictionary it used."""
    return combined_digest(files).select(
        F.lit(version).alias("version"), F.lit(patch).alias("patch"), "sha256",
        F.lit("sha256-canonical-json-v1").alias("hash_algorithm"), F.lit("bounded-source-relevant-v2").alias("selection_mode"),
    )
