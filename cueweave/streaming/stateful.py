"""Interval tracking and run merging over unbounded sources."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as tx
from ..operators.ordered import rows_of
from ..operators.tracking import TRACKED, Line, TrackerConfig, finish, full_row, observation, step

_STATE = "payload binary, newest double"
_EVENT_TIME = "event_time"
# Video time starts at zero, where the first watermark also stands and would drop the first row.
_ORIGIN = 86_400


def with_event_time(rows: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Add the event time of float seconds and the watermark that bounds lateness."""
    return rows.withColumn(_EVENT_TIME, F.timestamp_micros(F.round((F.col(ts) + _ORIGIN) * 1_000_000).cast("long"))).withWatermark(_EVENT_TIME, delay)


def _stateful(
    rows: DataFrame, keys: list[str], out: T.StructType, advance: Callable, close: Callable, idle_ms: int
) -> DataFrame:
    """Ordered per-key processing with a late side output and an idle timer.

    ``advance(payload, row)`` returns (output rows, payload); ``close(payload, newest)`` returns
    the last output rows of a key.
    """
    schema = T.StructType([*[rows.schema[k] for k in keys], *out.fields])
    names = schema.names

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        head = dict(zip(keys, key))
        produced: list[dict] = []
        payload, newest = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            produced += close(payload, newest)
            state.remove()
        else:
            # Only the rows of one key in one micro-batch, which the trigger bounds.
            batch = pd.concat(list(frames)).sort_values("ts", kind="stable")
            for row in rows_of(batch):
                if newest is not None and row["ts"] < newest:
                    produced.append({"kind": "late", "start_seconds": row["ts"], "end_seconds": row["ts"]})
                    continue
                newest = float(row["ts"])
                found, payload = advance(payload, row)
                produced += found
            state.update((payload, newest))
            state.setTimeoutTimestamp(max(int((newest + _ORIGIN) * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        if produced:
            yield pd.DataFrame([{**head, **{n: p.get(n) for n in out.names}} for p in produced], columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def track_intervals_stream(
    features: DataFrame, config: TrackerConfig = TrackerConfig(), range_end: float | None = None, interval: float = 0.2,
    delay: str = "10 seconds", idle_ms: int = 60_000,
) -> DataFrame:
    """Emit intervals of every line once their end is confirmed.

    State is the reference sample, the few pending samples, the three best views and how
    often each similarity was seen. A silent line ends at ``range_end``, or one interval after its last sample.
    """

    def advance(payload: bytes | None, row: dict):
        line = pickle.loads(payload) if payload else Line()
        found = step(line, observation(row), config)
        return [full_row(f) for f in found], pickle.dumps(line, protocol=5)

    def close(payload: bytes | None, newest: float):
        line = pickle.loads(payload) if payload else Line()
        end = range_end if range_end is not None else newest + interval
        return [full_row(f) for f in finish(line, end, config)]

    return _stateful(with_event_time(features, delay), ["video_id", "line_id"], TRACKED, advance, close, idle_ms)


RUN = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("start_seconds", T.DoubleType()),
    T.StructField("end_seconds", T.DoubleType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("raw_lines", T.ArrayType(T.StringType())),
    T.StructField("source_ko", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("message", T.StringType()),
])


def merge_runs_stream(
    samples: DataFrame, interval: float, range_end: float | None = None, keys: tuple[str, ...] = ("video_id", "line_id"),
    delay: str = "10 seconds", idle_ms: int = 60_000,
) -> DataFrame:
    """Captions from samples as they close: on another text, on no text, on an error, or on silence.

    Lines of a reading come from ``raw_lines`` of its first sample, where it lists any, else its text is the one line.
    """
    shown = (F.col("status") == "subtitle") & (F.length("_bare") > 0)
    keyed = samples.withColumn("_bare", tx.normalize_for_comparison("raw_text")).withColumn("_key", F.when(shown, F.col("_bare")))

    def caption(run: dict, end: float) -> dict:
        end = end if range_end is None else min(end, range_end)
        return {
            "kind": "caption", "start_seconds": run["start"], "end_seconds": max(run["start"], end), "raw_text": run["text"],
            "raw_lines": run["lines"], "source_ko": run["text"], "confidence": run["confidence"],
        }

    def advance(payload: bytes | None, row: dict):
        run = json.loads(payload) if payload else None
        found, key = [], row["_key"]
        if row["status"] == "ocr_error":
            found.append({"kind": "error", "start_seconds": row["ts"], "end_seconds": row["ts"], "message": row.get("error") or "OCR failed"})
        if run and run["key"] != key:
            found.append(caption(run, row["ts"]))
            run = None
        if key is not None and run is None:
            trust, lines = row["confidence"], row.get("raw_lines")
            lines = [row["raw_text"]] if lines is None or not len(lines) else list(lines)
            run = {"key": key, "start": row["ts"], "text": row["raw_text"], "lines": lines, "confidence": None if pd.isna(trust) else trust}
        return found, json.dumps(run).encode() if run else None

    def close(payload: bytes | None, newest: float):
        return [caption(json.loads(payload), newest + interval)] if payload else []

    return _stateful(with_event_time(keyed, delay), list(keys), RUN, advance, close, idle_ms)


def sessions_stream(rows: DataFrame, keys: tuple[str, ...], gap: str, delay: str = "10 seconds") -> DataFrame:
    """Runs that only a gap closes, by the built-in session window."""
    timed = with_event_time(rows, delay)
    out = timed.groupBy(*keys, F.session_window(_EVENT_TIME, gap).alias("w")).agg(F.count(F.lit(1)).alias("rows"))
    seconds = lambda c: F.unix_micros(c) / 1e6 - _ORIGIN
    return out.select(*keys, seconds(F.col("w.start")).alias("start_seconds"), seconds(F.col("w.end")).alias("end_seconds"), "rows")


def interval_sample_stream(frames: DataFrame, keys: tuple[str, ...], milliseconds: int = 200, delay: str = "10 seconds") -> DataFrame:
    """One frame per tumbling interval, the earliest; bounds as for a request."""
    if not 50 <= milliseconds <= 5_000:
        raise ValueError("interval must be from 50 to 5000 milliseconds")
    timed = with_event_time(frames, delay)
    rest = [c for c in frames.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col("ts"))
    window = F.window(_EVENT_TIME, f"{milliseconds} milliseconds")
    return timed.groupBy(*keys, window.alias("w")).agg(first.alias("_first")).select(*keys, "_first.*")
