"""Caption state: which text is in force, what an edit does to the status, what is shown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import is_blank, trim_space


def effective_source(corrected: Column, raw: Column) -> Column:
    """A non-blank correction wins over the recognised text."""
    return F.when(~is_blank(corrected), corrected).otherwise(raw)


def effective_translation(user: Column, generated: Column) -> Column:
    return F.when(~is_blank(user), user).otherwise(F.coalesce(generated, F.lit("")))


def status_after_edit(status: Column, source: Column, generated: Column, raw: Column, corrected: Column) -> Column:
    """Translation status once ``corrected`` is in force."""
    same = source.eqNullSafe(effective_source(corrected, raw))
    recovered = F.when(F.coalesce(F.length(generated), F.lit(0)) > 0, F.lit("completed")).otherwise("pending")
    return F.when(~same, F.lit("stale")).when(status == "stale", recovered).otherwise(status)


def with_user_edit(caption: Column, corrected: Column) -> Column:
    """Store a correction in a caption struct (blank means none) and refresh its status."""
    stored = F.when(~is_blank(corrected), corrected)
    translation = caption["translation"]
    status = status_after_edit(
        translation["status"], translation["source_ko"], translation["generated_ja"],
        caption["ocr"]["raw_text"], stored,
    )
    return caption.withField("corrected_ko", stored).withField("translation.status", status)


def with_user_translation(caption: Column, value: Column) -> Column:
    """User text is stored as it is; only the empty string becomes null."""
    return caption.withField("translation.user_ja", F.when(F.length(value) > 0, value))


def with_generated(caption: Column, generated: Column, source: Column | None = None) -> Column:
    """Store generated text, trimmed; user text is never touched.

    Blank generated text leaves the translation text alone and marks an error.
    """
    used = effective_source(caption["corrected_ko"], caption["ocr"]["raw_text"])
    if source is not None:
        used = F.coalesce(F.when(F.length(source) > 0, source), used)
    empty = is_blank(generated)
    translation = caption["translation"]
    return (
        caption.withField("translation.generated_ja", F.when(empty, translation["generated_ja"]).otherwise(trim_space(generated)))
        .withField("translation.source_ko", F.when(empty, translation["source_ko"]).otherwise(used))
        .withField("translation.status", F.when(empty, F.lit("error")).otherwise("completed"))
        .withField("translation.error", F.when(empty, F.lit("nothing generated")))
    )


def is_shown(corrected: Column, raw: Column, user: Column, status: Column, generated: Column) -> Column:
    """A caption is listed if it has source text or a translation that may be displayed."""
    completed = (status == "completed") & ~is_blank(generated)
    return ~is_blank(effective_source(corrected, raw)) | ~is_blank(user) | F.coalesce(completed, F.lit(False))


def display_state(user: Column, status: Column, generated: Column) -> Column:
    """What the translation side of a listed caption shows."""
    return (
        F.when(~is_blank(user), F.lit("user"))
        .when(status.isin("stale", "pending", "error"), status)
        .when(~is_blank(generated), F.lit("text"))
        .otherwise("none")
    )


def playback_state(has_result: Column, t: Column, start: Column, end: Column) -> Column:
    """The outer state: no result yet, outside the half-open range, or inside it."""
    return (
        F.when(~F.coalesce(has_result, F.lit(False)), F.lit("no_result"))
        .when((t < start) | (t >= end), F.lit("outside"))
        .otherwise("inside")
    )
