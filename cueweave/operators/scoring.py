"""Batch scoring with functions of the user: recognition, inference with retries, translation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import short_batches, spread
from . import reviews, terms
from .ordered import rows_of


def strict_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], agree: Column) -> DataFrame:
    """Full outer 1:1 pairing; ``problem`` tells missing, extra and disagreeing records."""
    a = left.withColumn("_a", F.lit(True))
    b = right.withColumn("_b", F.lit(True))
    both = a.join(b, list(keys), "full_outer")
    problem = (
        F.when(F.col("_b").isNull(), "pair.absent").when(F.col("_a").isNull(), "pair.extra").when(~agree, "mismatch")
    )
    return both.withColumn("problem", problem).drop("_a", "_b")


def records_with_source(manifest: DataFrame, recognised: DataFrame) -> DataFrame:
    """Manifest images with their recognised text; the second frame of a line is primary."""
    ocr = recognised.select(
        F.col("image_id").alias("id"), F.col("raw_output").alias("ocr_ko"), F.col("ground_truth").alias("_truth"), F.col("group_id").alias("_group")
    )
    agree = F.col("_truth").eqNullSafe(F.col("ground_truth")) & F.col("_group").eqNullSafe(F.col("group_id"))
    pairs = strict_pairs(manifest, ocr, ["id"], agree)
    return pairs.withColumn("primary", F.endswith("id", F.lit("_f02"))).withColumnRenamed("ground_truth", "source_ko").drop("_truth", "_group")


# --- user functions ------------------------------------------------------------------------

_RECOGNISED = T.StructType([
    T.StructField("raw_output", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("inference_ms", T.DoubleType()),
    T.StructField("error", T.StringType()),
])


def recognize_batch(images: DataFrame, make: Callable[[], Callable[[dict], tuple[str, float | None]]], warmups: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """Apply a recogniser to every row.

    ``make`` runs once per partition and returns the function; ``warmups`` calls on the first row
    are made first and not recorded. An exception marks its row and nothing else.
    """
    keep = list(keep) or [f.name for f in images.schema if not isinstance(f.dataType, T.BinaryType)]
    schema = T.StructType([*[images.schema[c] for c in keep], *_RECOGNISED.fields])

    def run(batches):
        recognise = None
        for frame in batches:
            if frame.empty:
                continue
            if recognise is None:
                recognise = make()
                first = next(rows_of(frame.head(1)))
                for _ in range(warmups):
                    recognise(first)
            found = []
            for row in rows_of(frame):
                began = time.perf_counter()
                try:
                    text, confidence = recognise(row)
                    error = None
                except Exception as problem:  # noqa: BLE001 - the row carries its error
                    text, confidence, error = None, None, f"{type(problem).__name__}: {problem}"
                found.append((text, confidence, (time.perf_counter() - began) * 1000 if error is None else None, error))
            scored = pd.DataFrame(found, columns=_RECOGNISED.names)
            yield pd.concat([frame[keep].reset_index(drop=True), scored], axis=1)

    return spread(images).mapInPandas(run, schema)


RETRY = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("thinking", T.StringType()),
    T.StructField("done_reason", T.StringType()),
    T.StructField("eval_count", T.LongType()),
    T.StructField("errors", T.ArrayType(T.StructType([
        T.StructField("attempt", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
    ]))),
    T.StructField("wall_ms", T.DoubleType()),
])


def attempt_outcome(response: dict) -> tuple[str, str | None]:
    """``ok``, ``stop`` or ``retry`` for a response, with the type of error it is."""
    content = (response.get("message") or {}).get("content")
    if response.get("done") is not True or not isinstance(content, str):
        return "retry", "ValueError"
    if content.strip():
        return "ok", None
    if response.get("done_reason") == "length":
        return "stop", "OutputLimitWithoutTranslation"
    return "retry", "ValueError"


def call_with_retry(call: Callable[[str], dict], payload: str, attempts: int = 2, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Bounded retries: client errors and cut-off blank answers end at once, others back off."""
    errors, last, outcome, began = [], None, "retry", time.perf_counter()
    for number in range(1, attempts + 1):
        kind, code = None, None
        try:
            last = call(payload)
            outcome, kind = attempt_outcome(last)
        except (OSError, ValueError) as problem:
            code = getattr(problem, "code", None)
            outcome, kind = "stop" if code is not None and code < 500 else "retry", type(problem).__name__
        if kind is not None:
            errors.append({"attempt": number, "type": kind, "http_status": code})
        if outcome != "retry":
            break
        if number < attempts:
            sleep(2 ** (number - 1))
    answer = last or {}
    message = answer.get("message") or {}
    return {
        "status": "ok" if outcome == "ok" else "error", "content": message.get("content"), "thinking": message.get("thinking"),
        "done_reason": answer.get("done_reason"), "eval_count": answer.get("eval_count"), "errors": errors,
        "wall_ms": (time.perf_counter() - began) * 1000,
    }


def infer_with_retry(jobs: DataFrame, make: Callable[[], Callable[[str], dict]], payload: str = "payload", attempts: int = 2, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Call a model for every row; adds the struct ``result`` with status, answer and error log.

    A partition without rows never builds the client.
    """
    schema = T.StructType([*jobs.schema.fields, T.StructField("result", RETRY)])

    def run(batches):
        call = None
        for frame in batches:
            if frame.empty:
                continue
            call = call or make()
            results = [call_with_retry(call, p, attempts, sleep) for p in frame[payload]]
            yield frame.assign(result=results)

    return spread(jobs).mapInPandas(run, schema)


def _answers(payload: Column, make: Callable[[], Callable[[str], dict]], attempts: int, sleep: Callable[[float], None]) -> Column:
    """The result of ``infer_with_retry`` beside each payload; only payloads go to Python, and none is called for null.

    Marked as not deterministic, so that no filter on the answers makes Spark call twice.
    """
    nothing = dict.fromkeys(RETRY.names)

    @F.pandas_udf(RETRY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = None
        for batch in batches:
            if call is None and batch.notna().any():
                call = make()
            yield pd.DataFrame([nothing if p is None else call_with_retry(call, p, attempts, sleep) for p in batch], columns=RETRY.names, dtype=object)

    return run.asNondeterministic()(payload)


def retry_outcomes(log: DataFrame, keys: Sequence[str], attempts: int = 2) -> DataFrame:
    """Fold a table of attempts (attempt, outcome) the way a live call would have ended."""
    used = log.filter(F.col("attempt") <= attempts)
    ended = F.when(F.col("outcome") != "retry", F.col("attempt"))
    out = used.groupBy(*keys).agg(
        F.min(ended).alias("_end"), F.min_by("outcome", ended).alias("_how"), F.max("attempt").alias("_last")
    )
    ok = F.coalesce(F.col("_how") == "ok", F.lit(False))
    return out.select(
        *keys, F.when(ok, "ok").otherwise("error").alias("status"), F.coalesce("_end", "_last").cast("long").alias("calls"),
        (F.coalesce("_end", "_last") - ok.cast("int")).cast("long").alias("failures"),
    )


# --- translation pipeline ------------------------------------------------------------------


def translate(captions: DataFrame, context: DataFrame, model: str, prompts: dict, make: Callable[[], Callable[[str], dict]], attempts: int = 2, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Translate captions (id, source_ko, ocr_status) with the context chosen for each text.

    Only completed, non-blank captions are sent. The result has status, generated text, error
    and call count per caption; ``trace`` holds the matches the prompt was made of.
    """
    chosen = context.select(F.col("text_id").alias("id"), "prompt_text", F.col("matches").alias("trace"))
    return _translated(captions.join(chosen, "id", "left"), captions.columns, model, prompts, make, attempts, sleep)


def translate_with(captions: DataFrame, entries: DataFrame, aliases: DataFrame, model: str, prompts: dict, make: Callable[[], Callable[[str], dict]], attempts: int = 2, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``translate`` with the context that a dictionary gives, which comes with the captions, so they are shuffled once."""
    context = terms.select_context(captions, entries, aliases, "id", "source_ko", keep=[c for c in captions.columns if c != "id"])
    rows = context.withColumnsRenamed({"text_id": "id", "matches": "trace"})
    return _translated(rows, captions.columns, model, prompts, make, attempts, sleep)


def _translated(rows: DataFrame, columns: Sequence[str], model: str, prompts: dict, make: Callable[[], Callable[[str], dict]], attempts: int, sleep: Callable[[float], None]) -> DataFrame:
    """``translate`` for captions that hold their ``prompt_text`` and ``trace``."""
    short_batches(rows.sparkSession)
    ready = (F.col("ocr_status") == "completed") & ~tx.is_blank("source_ko")
    payload = F.to_json(reviews.build_payload(model, F.col("source_ko"), prompts, F.col("prompt_text")))
    sent = spread(rows.withColumn("payload", F.when(ready, payload)).withColumn("_called", F.col("payload").isNotNull()))
    out = sent.withColumn("result", _answers(F.col("payload"), make, attempts, sleep))
    ok = F.coalesce(F.col("result.status") == "ok", F.lit(False))
    called = F.col("_called")
    kinds = F.array_join(F.transform("result.errors", lambda e: e["type"]), ", ")
    error = (
        F.when(called & ~ok, F.concat(F.lit("translation failed: "), kinds))
        .when(~called & (F.col("ocr_status") == "completed"), "no source text")
    )
    return out.select(
        *columns, "trace",
        F.when(ok, "completed").when(error.isNotNull(), "error").otherwise("pending").alias("translation_status"),
        F.when(ok, tx.trim_space("result.content")).alias("generated_ja"), error.alias("error"), called.cast("int").alias("calls"),
    )


def translation_errors(translated: DataFrame) -> DataFrame:
    return translated.filter("translation_status = 'error'").select(
        F.lit("translation").alias("phase"), F.col("id").alias("subtitle_id"), F.col("error").alias("message")
    )


def compare_conditions(cases: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Case rows with both outcomes checked and labelled.

    ``before`` and ``after`` have (id, output, selected); cases have the required terms and the
    target ids that each side must and must not select.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", F.col("output").alias(f"{name}_output"), F.col("selected").alias(f"{name}_selected"))

    both = cases.join(side(before, "baseline"), "id").join(side(after, "current"), "id")
    required = F.coalesce("required_ja", F.array().cast("array<array<string>>"))
    none = F.array().cast("array<string>")
    ids = lambda c: F.coalesce(F.col(c), none) if c in cases.columns else none
    checked = both.withColumns({
        "baseline_pass": reviews.term_check(F.coalesce("baseline_output", F.lit("")), required),
        "current_pass": reviews.term_check(F.coalesce("current_output", F.lit("")), required),
        "baseline_selection": reviews.selection_check(F.coalesce("baseline_selected", none), ids("expected_baseline_target_ids"), ids("forbidden_baseline_target_ids")),
        "current_selection": reviews.selection_check(F.coalesce("current_selected", none), ids("expected_target_ids"), ids("forbidden_target_ids")),
    })
    return checked.withColumn("comparison", reviews.comparison_label(F.col("baseline_pass"), F.col("current_pass")))


def compare_dictionaries(cases: DataFrame, before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], model: str, prompts: dict, make: Callable[[], Callable[[str], dict]], attempts: int = 2, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Translate the same cases with two dictionaries, each (entries, aliases), and compare what they select and give.

    ``cases`` has id, source_ko and the expectations of ``compare_conditions``.
    """

    def branch(entries: DataFrame, aliases: DataFrame) -> DataFrame:
        captions = cases.select("id", "source_ko", F.lit("completed").alias("ocr_status"))
        out = translate_with(captions, entries, aliases, model, prompts, make, attempts, sleep)
        selected = F.array_distinct(F.flatten(F.transform("trace", lambda m: m["target_ids"])))
        return out.select("id", F.col("generated_ja").alias("output"), selected.alias("selected"))

    return compare_conditions(cases, branch(*before), branch(*after))


def comparison_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count(F.lit(1)).alias("case_count"),
        *[F.count_if(F.col("comparison") == c).alias(c) for c in ("improved", "regressed", "unchanged_pass", "unchanged_fail")],
        F.count_if("baseline_selection.passed").alias("baseline_selection_checks_passed"),
        F.count_if("current_selection.passed").alias("current_selection_checks_passed"),
        F.count_if("baseline_pass").alias("baseline_term_checks_passed"), F.count_if("current_pass").alias("current_term_checks_passed"),
    )
