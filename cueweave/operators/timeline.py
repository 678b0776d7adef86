"""Caption timelines: runs of samples, stabilisation, overlap and point-in-time lookups."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .ordered import FOLD_ROWS, ordered_fold, rows_of, rows_per_task, sequence_of

TOLERANCE = 1e-9
STATUSES = ("subtitle", "no_subtitle", "ocr_error")


def merge_runs(
    samples: DataFrame,
    interval: float,
    range_end: float | Column | None = None,
    keys: Sequence[str] = ("video_id", "line_id"),
    order: Sequence[str] = ("ts",),
    target_rows: int | None = None,
) -> DataFrame:
    """Captions from samples: each run of equal text, ended by the time of the next sample.

    Only run starts are kept, so a caption carries the fields of its first sample and its end is
    the next start of any kind; the last run of a line ends one interval after its last sample.
    """
    end = F.lit(None).cast("double") if range_end is None else (range_end if isinstance(range_end, Column) else F.lit(float(range_end)))
    bare = tx.normalize_for_comparison("raw_text")
    shown = (F.col("status") == "subtitle") & (F.length(bare) > 0)
    # Text is normalised once, in a projection of its own.
    keyed = samples.withColumn("_text", F.when(shown, bare)).withColumn("_range_end", end)
    start = F.col(order[0])
    # The last row of a line is kept too, as the end of its last run depends on it.
    rows = sequence_of(keyed, keys, order, target_rows).next(_after=F.struct(start.alias("ts")))
    rows = rows.previous(_before=F.struct(F.col("_text").alias("key")))
    begins = F.col("_before").isNull() | ~F.col("_before.key").eqNullSafe(F.col("_text"))
    kept = rows.with_columns(_begins=begins).filter(F.col("_begins") | F.col("_after").isNull())
    ended = kept.next(_following=F.struct(start.alias("ts"), F.col("_begins").alias("begins"))).done()
    following = F.col("_following")
    stop = F.when(following["begins"], following["ts"]).otherwise(F.coalesce(following["ts"], start) + F.lit(interval))
    closed = ended.filter(F.col("_begins") & F.col("_text").isNotNull()).withColumn("_next", stop)
    lines = F.when(F.size("raw_lines") > 0, F.col("raw_lines")).otherwise(F.array("raw_text"))
    return closed.select(
        *keys,
        start.alias("start_seconds"),
        F.greatest(start, F.least(F.col("_next"), F.col("_range_end"))).alias("end_seconds"),
        "raw_text",
        lines.alias("raw_lines"),
        "confidence",
        F.col("raw_text").alias("source_ko"),
    )


def sample_errors(samples: DataFrame, keys: Sequence[str] = ("video_id", "line_id")) -> DataFrame:
    """Side table of failed samples."""
    message = F.when(F.length("error") > 0, F.col("error")).otherwise("OCR failed")
    return samples.filter("status = 'ocr_error'").select(
        *keys, F.lit("ocr").alias("phase"), F.col("ts").alias("timestamp_seconds"), message.alias("message")
    )


def order_violations(samples: DataFrame, keys: Sequence[str], arrival: Sequence[str], ts: str = "ts", target_rows: int | None = None) -> DataFrame:
    """Rows whose time falls below that of the row that arrived before them; equal is allowed."""
    seq = sequence_of(samples, keys, arrival, target_rows).previous(previous_ts=F.col(ts))
    return seq.filter(F.col("previous_ts") > F.col(ts)).done()


def unknown_statuses(samples: DataFrame) -> DataFrame:
    return samples.filter(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))


def split_by_duration(intervals: DataFrame, minimum: float, start: str = "start_seconds", end: str = "end_seconds") -> DataFrame:
    """Add ``reason``: null for intervals kept, a text for those dropped as too short."""
    closed = F.greatest(F.col(start), F.col(end))
    short = closed - F.col(start) + F.lit(TOLERANCE) < minimum
    return intervals.withColumn(end, closed).withColumn("reason", F.when(short, F.lit("shorter_than_minimum_duration")))


def merge_by_gap(rows: DataFrame, keys: Sequence[str], start: str, end: str, maximum_gap: float, order: Sequence[str] = (), target_rows: int | None = None) -> DataFrame:
    """Join neighbours whose gap is within ``maximum_gap``; intervals of a key must not overlap.

    Works on island starts only: an island ends where the row before the next start ended.
    """
    seq = sequence_of(rows, keys, [start, *order], target_rows).previous(_end_before=F.col(end))
    gap = F.col(start) - F.col("_end_before")
    opens = F.col("_end_before").isNull() | (gap > maximum_gap + TOLERANCE)
    islands = seq.running_sum(island=F.when(opens, 1).otherwise(0)).done()
    return islands.groupBy(*keys, "island").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("members")
    )


_CAPTION = T.StructType([
    T.StructField("start_seconds", T.DoubleType()),
    T.StructField("end_seconds", T.DoubleType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("raw_lines", T.ArrayType(T.StringType())),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source_ko", T.StringType()),
    T.StructField("variants", T.ArrayType(T.StructType([
        T.StructField("start_seconds", T.DoubleType()),
        T.StructField("end_seconds", T.DoubleType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("raw_lines", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
    ]))),
])
_VARIANT = ("start_seconds", "end_seconds", "raw_text", "raw_lines", "confidence")


def _edits_within(a: str, b: str, allowed: int) -> bool:
    """Whether two short strings are at most ``allowed`` edits apart."""
    if abs(len(a) - len(b)) > allowed:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        if min(row) > allowed:
            return False
    return row[-1] <= allowed


def _compatible(a: dict, b: dict) -> bool:
    """The temporal variant rule on token columns prepared by Spark."""
    x, y = a["bare"], b["bare"]
    if x == y:
        return True
    longest = max(len(x), len(y))
    if a["hangul"] and b["hangul"] and longest >= 4 and a["protected"] == b["protected"]:
        if _edits_within(x, y, max(1, int(longest * tx.CONSERVATIVE_EDIT_RATIO))):
            return True
    x, y = a["hangul"], b["hangul"]
    if min(len(x), len(y)) < 2:
        return False
    if any(a[t] and b[t] and a[t] != b[t] for t in ("numbers", "slots")):
        return False
    return _edits_within(x, y, max(1, int(max(len(x), len(y)) * tx.TEMPORAL_EDIT_RATIO)))


def _better(candidate: float | None, current: float | None) -> bool:
    return candidate is not None and (current is None or candidate > current)


def stabilize(
    captions: DataFrame,
    maximum_gap: float,
    minimum_duration: float = 0.6,
    keys: Sequence[str] = ("video_id", "line_id"),
    order: Sequence[str] = ("start_seconds", "end_seconds"),
    target_rows: int | None = None,
) -> DataFrame:
    """Merge neighbours that are variants of one reading, then drop short captions.

    The reading compared is the best one so far, so this is a fold and not a window. Tokens and
    normal forms are prepared by Spark; the fold only compares and keeps one open caption. A gap
    above the limit always closes the caption, so keys are cut there first and no state crosses;
    only a stretch without such a gap that exceeds a task is folded slice by slice.
    """
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    prepared = (
        captions.withColumn("_nfc", tx.nfc(text))
        .withColumn("bare", tx.remove_whitespace("_nfc"))
        .withColumn("hangul", F.regexp_replace("_nfc", "[^가-힣]", ""))
        .withColumn("protected", F.array_join(tx.protected_tokens("bare"), "\n"))
        .withColumn("numbers", F.array_join(F.regexp_extract_all("_nfc", F.lit(tx.NUMBER), F.lit(0)), "\n"))
        .withColumn("slots", F.array_join(F.transform(F.regexp_extract_all("_nfc", F.lit(tx.SLOT_LETTER), F.lit(0)), F.upper), "\n"))
        .drop("_nfc")
    )
    tokens = ("bare", "hangul", "protected", "numbers", "slots")

    def opened(row: dict) -> dict:
        shape = {n: row[n] for n in ("start_seconds", "end_seconds", "raw_text", "source_ko", *tokens)}
        lines = row["raw_lines"]
        shape["raw_lines"] = None if lines is None else list(lines)
        shape["confidence"] = None if pd.isna(row["confidence"]) else float(row["confidence"])
        return {**shape, "variants": None}

    def fold(rows: pd.DataFrame, state: bytes | None, last: bool):
        current = json.loads(state) if state else None
        produced = []

        def emit(caption: dict | None) -> None:
            if caption and caption["end_seconds"] - caption["start_seconds"] >= minimum_duration - TOLERANCE:
                produced.append({n: caption[n] for n in _CAPTION.names})

        for row in map(opened, rows_of(rows)):
            near = current is not None and row["start_seconds"] - current["end_seconds"] <= maximum_gap + TOLERANCE
            if not (near and _compatible(current, row)):
                emit(current)
                current = row
                continue
            if current["variants"] is None:
                current["variants"] = [{n: current[n] for n in _VARIANT}]
            current["variants"].append({n: row[n] for n in _VARIANT})
            current["end_seconds"] = row["end_seconds"]
            if _better(row["confidence"], current["confidence"]):
                current.update({n: row[n] for n in ("raw_text", "raw_lines", "confidence", *tokens)})
                current["source_ko"] = row["raw_text"]
        if last:
            emit(current)
            current = None
        return produced, None if current is None else json.dumps(current, sort_keys=True).encode()

    cut = _cut_at_gaps(prepared, keys, order, maximum_gap, rows_per_task(captions, target_rows, FOLD_ROWS), target_rows)
    return ordered_fold(cut, [*keys, "_chunk"], order, fold, _CAPTION, target_rows).drop("_chunk")


def _cut_at_gaps(rows: DataFrame, keys: Sequence[str], order: Sequence[str], maximum_gap: float, size: int, target_rows: int | None) -> DataFrame:
    """Add ``_chunk``: whole stretches without a gap above ``maximum_gap``, put together until they hold about ``size`` rows."""
    seq = sequence_of(rows, keys, order, target_rows).previous(_stop=F.col("end_seconds")).row_number("_n")
    resets = F.col("_stop").isNull() | (F.col("start_seconds") - F.col("_stop") > maximum_gap + TOLERANCE)
    seq = seq.running_max(_first=F.when(resets, F.col("_n")))
    return seq.done().withColumn("_chunk", F.floor((F.col("_first") - 1) / size)).drop("_stop", "_n", "_first")


def assign_ids(captions: DataFrame, keys: Sequence[str] = ("video_id",), order: Sequence[str] = ("start_seconds", "line_index", "end_seconds"), target_rows: int | None = None) -> DataFrame:
    """Number captions per video in time order: ``subtitle-00001`` and on."""
    numbered = sequence_of(captions, keys, order, target_rows).row_number("ordinal").done()
    return numbered.withColumn("id", F.format_string("subtitle-%05d", "ordinal"))


def representative_score(sharpness: Column, presence: Column, stability: Column) -> Column:
    focus = F.lit(1.0) - F.exp(-F.greatest(F.lit(0.0), sharpness) / 500)
    return 0.4 * focus + 0.35 * presence + 0.25 * stability


def top_per_group(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], n: int = 3) -> DataFrame:
    """Best ``n`` rows per group; each map task keeps only its own best before the shuffle."""
    best = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def confirmed_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, target_rows: int | None = None) -> DataFrame:
    """Runs of a label that two equal samples in a row confirm.

    A single odd sample is ignored, neighbours of equal label are one run, and a run ends where
    the next confirmed one starts; the last end is null.
    """
    seq = sequence_of(rows, keys, order, target_rows)
    seq = seq.previous(_before=F.col(value)).next(_after=F.col(value))
    seeds = seq.filter(
        ~F.col("_before").eqNullSafe(F.col(value)) & F.col("_after").eqNullSafe(F.col(value)) & F.col(value).isNotNull()
    )
    seeds = seeds.previous(_kept=F.col(value)).filter(~F.col("_kept").eqNullSafe(F.col(value)))
    out = seeds.next(end=F.col(order[0])).done()
    return out.select(*keys, F.col(value), F.col(order[0]).alias("start"), "end")


def fixed_interval_sample(frames: DataFrame, keys: Sequence[str], ts: str, seconds: float, ties: Sequence[str] = ()) -> DataFrame:
    """First row of each tumbling interval, by a partial aggregate."""
    slot = F.floor(F.col(ts) / seconds).cast("long")
    rest = [c for c in frames.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(ts, *ties))
    return frames.groupBy(*keys, slot.alias("interval_index")).agg(first.alias("_first")).select(*keys, "interval_index", "_first.*")


def frame_range_filter(frames: DataFrame, start: float, end: float, interval: float, source_start: float = 0.0, pts: str = "pts") -> DataFrame:
    """Frames of a half-open range, one interval of lead-in allowed; stateless, so it streams."""
    at = F.col(pts) - source_start
    return frames.withColumn("ts", at).filter((at >= start - interval - 1e-6) & (at < end - 1e-6))


def numbered_frames(
    frames: DataFrame, keys: Sequence[str], start: float, end: float, interval: float, source_start: float = 0.0, pts: str = "pts",
    ties: Sequence[str] = (), target_rows: int | None = None,
) -> DataFrame:
    """Frames of a half-open range with ``frame_index``, counted from 0 per key in time order."""
    kept = frame_range_filter(frames, start, end, interval, source_start, pts)
    numbered = sequence_of(kept, keys, ["ts", *ties], target_rows).row_number("_n").done()
    return numbered.withColumn("frame_index", F.col("_n") - 1).drop("_n")


def range_report(requests: DataFrame, numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames taken per requested key; ``problem`` is ``range.empty`` where a request yielded none."""
    counts = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"))
    taken = F.coalesce(F.col("frames"), F.lit(0).cast("long"))
    out = requests.select(*keys).distinct().join(counts, list(keys), "left")
    return out.select(*keys, taken.alias("frames"), F.when(taken == 0, "range.empty").alias("problem"))


def gap_sessions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], gap: float, target_rows: int | None = None) -> DataFrame:
    """Sessions that only a silence of ``gap`` or more closes; a session ends one gap after its last row."""
    at = F.col(order[0])
    seq = sequence_of(rows, keys, order, target_rows).previous(_before=at)
    opens = F.col("_before").isNull() | (at - F.col("_before") >= gap)
    numbered = seq.running_sum(session=F.when(opens, 1).otherwise(0)).done()
    return numbered.groupBy(*keys, "session").agg(F.min(at).alias("start"), (F.max(at) + F.lit(gap)).alias("end"), F.count(F.lit(1)).alias("rows"))


def order_in_group(texts: DataFrame, keys: Sequence[str], order: str, text: str, name: str = "joined") -> DataFrame:
    """Lines of a group in reading order, joined by newlines (the value is the whole group)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    return texts.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p[text]), "\n").alias(name))


def attempt_ledger(
    attempts: DataFrame, keys: Sequence[str], rank: str = "attempt", text: str = "raw_text", confidence: str = "confidence", limit: int = 3,
    accepted: Column | None = None, error: str | None = None,
) -> DataFrame:
    """Outcome of up to ``limit`` tries with the ledger of those made: the first accepted one, else the surest as fallback.

    ``attempts`` of the result lists each try up to the accepted one with its trimmed text and a reason code if it was turned
    down: ``ocr_exception`` (column ``error`` set), ``empty_ocr`` or ``low_information_ocr``. A try has one place in the
    ledger, so its size is bounded by ``limit`` whatever the input repeats.
    """
    failed = F.col(error).isNotNull() if error else F.lit(False)
    tried = attempts.filter(F.col(rank).between(1, limit)).select(
        *keys, F.col(rank).cast("int").alias("attempt"), failed.alias("_failed"),
        (F.col(error) if error else F.lit(None)).cast("string").alias("error"),
        (F.lit(True) if accepted is None else accepted).alias("_given"),
        F.when(failed, "").otherwise(F.coalesce(tx.trim_space(text), F.lit(""))).alias("raw_text"),
        F.when(~failed, F.col(confidence)).cast("double").alias("confidence"),
    )
    empty = F.col("raw_text") == ""
    fine = ~F.col("_failed") & F.coalesce(F.col("_given"), F.lit(False))
    if accepted is None:
        fine = fine & ~empty & ~tx.is_low_information("raw_text", "confidence")
    reason = F.when(F.col("_failed"), "ocr_exception").when(~fine & empty, "empty_ocr").when(~fine, "low_information_ocr")
    entry = F.struct("attempt", "raw_text", "confidence", fine.alias("accepted"), reason.alias("rejection_reason"), "error")
    # The text tests call ICU, which an aggregate does not take; the entry is a column before.
    made = tried.select(*keys, "attempt", entry.alias("_entry")).groupBy(*keys).agg(
        F.array_compact(F.array(*[F.min(F.when(F.col("attempt") == i, F.col("_entry"))) for i in range(1, limit + 1)])).alias("_made")
    )
    hits = F.filter("_made", lambda e: e["accepted"])
    made = made.withColumn("_hit", F.try_element_at(hits, F.lit(1)))
    kept = F.filter("_made", lambda e: F.col("_hit").isNull() | (e["attempt"] <= F.col("_hit.attempt")))
    made = made.withColumn("attempts", kept)
    surest = F.array_max(F.transform("attempts", lambda e: F.struct(
        F.coalesce(e["confidence"], F.lit(-1.0)).alias("sure"), F.length(e["raw_text"]).alias("size"), (-e["attempt"]).alias("early"),
        e["raw_text"].alias("raw_text"), e["confidence"].alias("confidence"),
    )))
    hit = F.col("_hit").isNotNull()
    chosen = made.withColumn("_fallback", surest)
    pick = lambda name: F.when(hit, F.col(f"_hit.{name}")).otherwise(F.col(f"_fallback.{name}")).alias(name)
    return chosen.select(
        *keys, F.when(hit, "completed").otherwise("error").alias("status"), pick("raw_text"), pick("confidence"),
        F.size("attempts").cast("long").alias("call_count"), "attempts",
    )


def first_accepted(attempts: DataFrame, keys: Sequence[str], rank: str = "attempt", text: str = "raw_text", confidence: str = "confidence", limit: int = 3, accepted: Column | None = None) -> DataFrame:
    """Outcome of ``attempt_ledger`` without the ledger."""
    return attempt_ledger(attempts, keys, rank, text, confidence, limit, accepted).drop("attempts")


def adjacent_change(rows: DataFrame, group: str, order: Sequence[str], text: str, distance: Column | None = None, target_rows: int | None = None) -> DataFrame:
    """Per group: neighbour pairs, changed pairs, change rate and mean relative edit distance."""
    seq = sequence_of(rows, [group], order, target_rows).previous(_p=F.struct(F.col(text).alias("t"))).done()
    before, now = F.col("_p.t"), F.col(text)
    longest = F.greatest(F.length(before), F.length(now), F.lit(1))
    apart = distance if distance is not None else F.levenshtein(before, now) / longest
    paired = F.col("_p").isNotNull()
    return seq.groupBy(group).agg(
        F.count_if(paired).alias("adjacent_pairs"),
        F.count_if(paired & (before != now)).alias("changed_pairs"),
        (F.sum(F.when(paired & (before != now), 1.0).when(paired, 0.0)) / F.nullif(F.count_if(paired), F.lit(0))).alias("change_rate"),
        F.avg(F.when(paired, apart)).alias("mean_normalized_edit_distance"),
    )


def stability_summary(per_group: DataFrame) -> DataFrame:
    """Every group with a pair counts the same, whatever its size."""
    return per_group.filter("adjacent_pairs > 0").agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg("change_rate").alias("group_mean_change_rate"),
        F.avg("mean_normalized_edit_distance").alias("group_mean_normalized_edit_distance"),
    )
