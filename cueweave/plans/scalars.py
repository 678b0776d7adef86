"""Scalar expressions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import captions as cap, digests, geometry as geo, text as tx
from ..operators import reviews
from ..operators.ordered import sequence_of
from .registry import pick, query, table


@query("normalize_text", r"""
SELECT conv_id, turn, sha256(regexp_replace(nfc_normalize(text), '{WS}+', '', 'g')) AS digest FROM conversations
""")
def normalize_text(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.sha2(tx.normalize_for_comparison("text"), 256).alias("digest")
    )


@query("normalize_newlines", r"""
SELECT doc_id, sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS digest,
       length(text)::BIGINT AS chars FROM documents
""")
def normalize_newlines(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.sha2(tx.normalize_text("text"), 256).alias("digest"), F.length("text").cast("long").alias("chars")
    )


@query("strip_ws_len", r"""
SELECT doc_id, length(regexp_replace(text, '{WS}+', '', 'g'))::BIGINT AS bare_chars FROM documents
""")
def strip_ws_len(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(tx.remove_whitespace("text")).cast("long").alias("bare_chars"))


@query("dictionary_key", "SELECT p_partkey, lower(p_name) AS key FROM part")
def dictionary_key(spark, d):
    loud = F.concat(F.lit(" "), F.upper("p_name"), F.lit("\t"))
    return table(spark, d, "part").select("p_partkey", tx.dictionary_key(loud).alias("key"))


@query("strip_tags", r"""
SELECT page_id, sha256(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^{WS}+|{WS}+$', '', 'g')) AS digest FROM pages
""")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(tx.clean_name("html"), 256).alias("digest"))


@query("edit_distance_ascii", "SELECT p_partkey, levenshtein(p_name, lower(p_type))::BIGINT AS edits FROM part")
def edit_distance_ascii(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.edit_distance("p_name", F.lower("p_type")).cast("long").alias("edits"))


@query("low_information", r"""
WITH t AS (SELECT d.doc_id, text, CASE WHEN toxic = 1 THEN 0.4 WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.55 END AS c
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, CASE WHEN c IS NULL OR c < 0.5 THEN true WHEN regexp_matches(text, '[가-힣]') THEN false
  ELSE length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) < 2 OR c < 0.6 END AS low FROM t
""")
def low_information(spark, d):
    trust = F.when(F.col("toxic") == 1, 0.4).when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.55)
    docs = table(spark, d, "documents", "doc_id", "text").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.select("doc_id", tx.is_low_information("text", trust).alias("low"))


@query("protected_tokens", r"""
SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[A-Za-z]+|\p{Nd}+(?:[.:]\p{Nd}+)?'), ' ')) AS digest,
       len(regexp_extract_all(text, '[A-Za-z]+|\p{Nd}+(?:[.:]\p{Nd}+)?'))::BIGINT AS tokens FROM documents
""")
def protected_tokens(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tx.protected_tokens("text").alias("t"))
    return docs.select("doc_id", F.md5(F.concat_ws(" ", "t")).alias("digest"), F.size("t").cast("long").alias("tokens"))


@query("temporal_tokens", r"""
SELECT doc_id, array_to_string(regexp_extract_all(nfc_normalize(text), '\p{Nd}+(?:[.:]\p{Nd}+)?'), ' ') AS numbers FROM documents
""")
def temporal_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", tx.number_tokens("text")).alias("numbers"))


@query("slot_tokens", r"""
SELECT doc_id, upper(array_to_string(list_filter(regexp_extract_all(nfc_normalize(text), '[A-Za-z]+'), lambda x: regexp_matches(x, '^[QWERDFqwerdf]$')), ' ')) AS slots FROM documents
""")
def slot_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", tx.slot_tokens("text")).alias("slots"))


def _part_neighbours(spark, d):
    parts = table(spark, d, "part", "p_partkey", "p_brand", "p_name")
    return sequence_of(parts, ["p_brand"], ["p_partkey"]).previous(before=F.col("p_name")).done().filter("before is not null")


_NEIGHBOURS = """
WITH n AS (SELECT p_partkey, p_name AS b, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS a FROM part),
m AS (SELECT p_partkey, a, b, replace(a, ' ', '') AS x, replace(b, ' ', '') AS y,
             regexp_replace(a, '[^a-z]', '', 'g') AS la, regexp_replace(b, '[^a-z]', '', 'g') AS lb FROM n WHERE a IS NOT NULL),
c AS (SELECT *, x = y OR (regexp_matches(x, '[a-z]') AND regexp_matches(y, '[a-z]')
        AND greatest(length(x), length(y)) >= 4
        AND regexp_extract_all(x, '[A-Za-z]+|[0-9]+(?:[.:][0-9]+)?') = regexp_extract_all(y, '[A-Za-z]+|[0-9]+(?:[.:][0-9]+)?')
        AND levenshtein(x, y) <= greatest(1, floor(greatest(length(x), length(y)) * 0.2))) AS close FROM m)
"""


@query("near_text_pairs", _NEIGHBOURS + "SELECT p_partkey, close FROM c")
def near_text_pairs(spark, d):
    return _part_neighbours(spark, d).select("p_partkey", tx.conservative_variants("before", "p_name", "[a-z]").alias("close"))


@query("temporal_pairs", _NEIGHBOURS + """
SELECT p_partkey, close OR (least(length(la), length(lb)) >= 2
  AND levenshtein(la, lb) <= greatest(1, floor(greatest(length(la), length(lb)) * 0.45))) AS variant FROM c
""")
def temporal_pairs(spark, d):
    return _part_neighbours(spark, d).select("p_partkey", tx.temporal_variants("before", "p_name", "[a-z]").alias("variant"))


@query("row_cer", r"""
WITH a AS (SELECT conv_id, turn, {TEXT} AS t FROM conversations),
p AS (SELECT conv_id, turn, t AS output, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS truth FROM a),
m AS (SELECT *, regexp_replace(truth, '{WS}+', '', 'g') AS bt, regexp_replace(output, '{WS}+', '', 'g') AS bo FROM p WHERE truth IS NOT NULL)
SELECT conv_id, turn, levenshtein(truth, output)::BIGINT AS edits, length(truth)::BIGINT AS characters,
  round(levenshtein(truth, output) / nullif(length(truth), 0)::DOUBLE, 9) AS cer,
  levenshtein(bt, bo)::BIGINT AS whitespace_free_edits,
  round(levenshtein(bt, bo) / nullif(length(bt), 0)::DOUBLE, 9) AS whitespace_free_cer, truth = output AS exact FROM m
""")
def row_cer(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", tx.normalize_text("text").alias("output"))
    pairs = sequence_of(turns, ["conv_id"], ["turn"]).previous(truth=F.col("output")).done().filter("truth is not null")
    m = tx.row_metrics("truth", "output", normalize=False)
    return pairs.select(
        "conv_id", "turn", m["edits"].cast("long").alias("edits"), m["characters"].cast("long").alias("characters"),
        F.round(m["cer"], 9).alias("cer"), m["whitespace_free_edits"].cast("long").alias("whitespace_free_edits"),
        F.round(m["whitespace_free_cer"], 9).alias("whitespace_free_cer"), m["exact"].alias("exact"),
    )


def _rects(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, d, "embeddings").select(
        "vec_id", e(0).alias("x"), F.abs(e(1)).alias("y"), (F.abs(e(2)) * 3).alias("w"), (F.abs(e(3)) * 5).alias("h")
    )


_RECTS = """
WITH r AS (SELECT vec_id, embedding[1]::DOUBLE AS x, abs(embedding[2]::DOUBLE) AS y,
                  abs(embedding[3]::DOUBLE) * 3 AS w, abs(embedding[4]::DOUBLE) * 5 AS h FROM embeddings),
v AS (SELECT *, x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x + w <= 1 + 1e-9 AND y + h <= 1 + 1e-9 AS ok FROM r)
"""


@query("region_pixels", _RECTS + """
, p AS (SELECT vec_id, ok AND w <= 1 AND h <= 1 AS ok, floor(x * 1920 + 0.5)::BIGINT AS l, floor(y * 1080 + 0.5)::BIGINT AS t,
               floor((x + w) * 1920 + 0.5)::BIGINT AS r, floor((y + h) * 1080 + 0.5)::BIGINT AS b FROM v)
SELECT vec_id, ok AND r > l AND b > t AS valid, CASE WHEN ok AND r > l AND b > t THEN l END AS "left",
  CASE WHEN ok AND r > l AND b > t THEN t END AS top, CASE WHEN ok AND r > l AND b > t THEN r - l END AS width,
  CASE WHEN ok AND r > l AND b > t THEN b - t END AS height FROM p
""")
def region_pixels(spark, d):
    box = geo.region_to_pixels(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1920), F.lit(1080))
    rows = _rects(spark, d).withColumn("box", box)
    parts = {n: F.col(f"box.{n}").cast("long") for n in ("left", "top", "width", "height")}
    return rows.select("vec_id", F.col("box").isNotNull().alias("valid"), *pick(**parts))


@query("even_crop", """
WITH r AS (SELECT vec_id, abs(embedding[1]::DOUBLE) AS x, abs(embedding[2]::DOUBLE) AS y,
                  abs(embedding[3]::DOUBLE) AS w, abs(embedding[4]::DOUBLE) AS h FROM embeddings),
o AS (SELECT *, greatest(0, least(1919 - 2, round_even(x * 1919, 0)::BIGINT)) AS x0,
                greatest(0, least(1080 - 2, round_even(y * 1080, 0)::BIGINT)) AS y0 FROM r),
q AS (SELECT *, x0 - x0 % 2 AS x1, y0 - y0 % 2 AS y1 FROM o),
s AS (SELECT *, greatest(x1 + 2, least(1919, round_even((x + w) * 1919, 0)::BIGINT)) - x1 AS cw,
                greatest(y1 + 2, least(1080, round_even((y + h) * 1080, 0)::BIGINT)) - y1 AS ch FROM q)
SELECT vec_id, x1 AS x, y1 AS y, greatest(2, cw - cw % 2) AS width, greatest(2, ch - ch % 2) AS height FROM s
""")
def even_crop(spark, d):
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    box = geo.crop_pixels_even(e(0), e(1), e(2), e(3), F.lit(1919), F.lit(1080))
    rows = table(spark, d, "embeddings").select("vec_id", box.alias("box"))
    return rows.select("vec_id", *pick(**{n: F.col(f"box.{n}").cast("long") for n in ("x", "y", "width", "height")}))


@query("region_valid_flags", _RECTS + "SELECT vec_id, ok FROM v")
def region_valid_flags(spark, d):
    ok = geo.region_valid(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return _rects(spark, d).select("vec_id", ok.alias("ok"))


@query("resolve_range", """
WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice AS dur, (o_custkey % 700) * 700.0::DOUBLE AS s, (o_custkey % 700) * 700.0::DOUBLE + o_totalprice / 2 AS e FROM orders),
r AS (SELECT *, CASE WHEN dur <= 0 THEN 'range.duration' WHEN o_orderstatus = 'F' THEN NULL
       WHEN s >= dur THEN 'range.start'
       WHEN e > dur + 0.05 THEN 'range.end' END AS error FROM o)
SELECT o_orderkey, error, round(CASE WHEN error IS NULL THEN CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE ELSE s END END, 4) AS start_s,
  round(CASE WHEN error IS NULL THEN CASE WHEN o_orderstatus = 'F' THEN dur ELSE least(e, dur) END END, 4) AS end_s FROM r
""")
def resolve_range(spark, d):
    start = (F.col("o_custkey") % 700) * F.lit(700.0)
    mode = F.when(F.col("o_orderstatus") == "F", "whole").otherwise("range")
    got = geo.resolve_range(mode, start, start + F.col("o_totalprice") / 2, F.col("o_totalprice"))
    rows = table(spark, d, "orders").select("o_orderkey", got.alias("r"))
    return rows.select("o_orderkey", F.col("r.error").alias("error"), F.round("r.start", 4).alias("start_s"), F.round("r.end", 4).alias("end_s"))


@query("line_slices", """
WITH p AS (SELECT p_partkey, p_size AS h, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 11) / 10.0::DOUBLE END AS ratio FROM part),
s AS (SELECT *, greatest(1, least(h - 1, round_even(h * ratio, 0)::INTEGER)) AS cut FROM p)
SELECT p_partkey, 'line-1' AS line_id, 0 AS line_index, 0 AS top, CASE WHEN ratio IS NULL THEN h ELSE cut END AS bottom
FROM s WHERE h > 0 AND (ratio IS NULL OR ratio BETWEEN 0.1 AND 0.9)
UNION ALL SELECT p_partkey, 'line-2', 1, cut, h FROM s WHERE h > 0 AND ratio BETWEEN 0.1 AND 0.9
""")
def line_slices(spark, d):
    ratio = F.when(F.col("p_partkey") % 7 > 0, (F.col("p_partkey") % 11) / F.lit(10.0))
    return table(spark, d, "part").select("p_partkey", F.inline(geo.line_slices(F.col("p_size"), ratio)))


@query("sample_grid", """
SELECT p_partkey, round(p_retailprice + 0.1 + unnest(range(p_size % 5)) * 0.2, 6) AS ts FROM part
""")
def sample_grid(spark, d):
    grid = geo.sample_grid(F.col("p_retailprice"), F.lit(0.2), (F.col("p_size") % 5).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.explode(grid).alias("ts")).withColumn("ts", F.round("ts", 6))


@query("frame_offsets", """
SELECT p_partkey, (step + 2)::INTEGER AS frame, round(p_retailprice + step / 30.0::DOUBLE, 6) AS ts, step = 0 AS "primary"
FROM part, (VALUES (-1), (0), (1)) v(step)
""")
def frame_offsets(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.inline(geo.frame_offsets(F.col("p_retailprice"), F.lit(30.0))))
    return rows.withColumn("ts", F.round("ts", 6))


def _edited(spark, d):
    """Documents as captions: raw text is the source name, a label is a user edit."""
    edit = F.when(F.col("quality") == 1, F.concat_ws("-", "source", "lang")).when(F.col("quality") == 0, F.lit(" \t"))
    docs = table(spark, d, "documents", "doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("doc_id") % 4 == 0, "stale").when(F.col("doc_id") % 4 == 1, "pending").when(F.col("doc_id") % 4 == 2, "error").otherwise("completed")
    used = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("-", "source", "lang")).otherwise(F.col("source"))
    made = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit(" "), F.col("lang")))
    return docs.select("doc_id", F.col("source").alias("raw"), edit.alias("edit"), status.alias("status"), used.alias("used"), made.alias("made"))


_EDITED = """
WITH e AS (SELECT d.doc_id, source AS raw, CASE quality WHEN 1 THEN source || '-' || lang WHEN 0 THEN ' ' END AS edit,
  CASE d.doc_id % 4 WHEN 0 THEN 'stale' WHEN 1 THEN 'pending' WHEN 2 THEN 'error' ELSE 'completed' END AS status,
  CASE WHEN d.doc_id % 3 = 0 THEN source || '-' || lang ELSE source END AS used,
  CASE WHEN d.doc_id % 5 > 0 THEN ' ' || lang END AS made FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
f AS (SELECT *, CASE WHEN trim(edit) <> '' THEN edit ELSE raw END AS effective FROM e)
"""


@query("effective_value", _EDITED + """
SELECT doc_id, effective, CASE WHEN trim(edit) <> '' THEN edit ELSE coalesce(made, '') END AS shown FROM f
""")
def effective_value(spark, d):
    return _edited(spark, d).select(
        "doc_id", cap.effective_source(F.col("edit"), F.col("raw")).alias("effective"),
        cap.effective_translation(F.col("edit"), F.col("made")).alias("shown"),
    )


@query("edit_status", _EDITED + """
SELECT doc_id, CASE WHEN used <> effective THEN 'stale' WHEN status = 'stale' THEN
  CASE WHEN made <> '' THEN 'completed' ELSE 'pending' END ELSE status END AS status FROM f
""")
def edit_status(spark, d):
    c = F.col
    return _edited(spark, d).select("doc_id", cap.status_after_edit(c("status"), c("used"), c("made"), c("raw"), c("edit")).alias("status"))


@query("apply_generated", _EDITED + """
SELECT doc_id, CASE WHEN trim(made) <> '' THEN 'completed' ELSE 'error' END AS status,
  CASE WHEN trim(made) <> '' THEN effective ELSE used END AS source_text,
  CASE WHEN trim(made) <> '' THEN trim(made) END AS generated, edit AS user_text FROM f
""")
def apply_generated(spark, d):
    caption = F.struct(
        F.col("edit").alias("corrected_ko"), F.struct(F.col("raw").alias("raw_text")).alias("ocr"),
        F.struct(
            F.col("status"), F.col("used").alias("source_ko"), F.lit(None).cast("string").alias("generated_ja"),
            F.when(F.col("edit").isNotNull(), F.regexp_replace("edit", "\t", "")).alias("user_ja"), F.lit(None).cast("string").alias("error"),
        ).alias("translation"),
    )
    rows = _edited(spark, d).select("doc_id", cap.with_generated(caption, F.col("made")).alias("c"))
    t = lambda n: F.col(f"c.translation.{n}")
    return rows.select("doc_id", *pick(status=t("status"), source_text=t("source_ko"), generated=t("generated_ja"), user_text=t("user_ja")))


@query("display_state", _EDITED + """
SELECT doc_id, CASE WHEN trim(edit) <> '' THEN 'user' WHEN status IN ('stale', 'pending', 'error') THEN status
  WHEN trim(made) <> '' THEN 'text' ELSE 'none' END AS state,
  CASE WHEN doc_id % 100 < 10 OR doc_id % 100 >= 90 THEN 'outside' ELSE 'inside' END AS playback FROM f
WHERE trim(CASE WHEN raw = 'forum' THEN coalesce(nullif(trim(edit), ''), '') ELSE effective END) <> '' OR trim(edit) <> '' OR (status = 'completed' AND trim(made) <> '')
""")
def display_state(spark, d):
    c = F.col
    raw = F.when(c("raw") == "forum", "").otherwise(c("raw"))
    rows = _edited(spark, d).filter(cap.is_shown(c("edit"), raw, c("edit"), c("status"), c("made")))
    at = (c("doc_id") % 100).cast("double")
    return rows.select(
        "doc_id", cap.display_state(c("edit"), c("status"), c("made")).alias("state"),
        cap.playback_state(F.lit(True), at, F.lit(10.0), F.lit(90.0)).alias("playback"),
    )


@query("row_digest", """
SELECT p_partkey, sha256('{"brand":"' || p_brand || '","key":' || p_partkey || ',"name":"' || p_name || '","size":null}') AS digest FROM part
""")
def row_digest(spark, d):
    kind = T.StructType([
        T.StructField("size", T.IntegerType()), T.StructField("name", T.StringType()),
        T.StructField("key", T.LongType()), T.StructField("brand", T.StringType()),
    ])
    row = F.struct(
        F.lit(None).cast("int").alias("size"), F.col("p_name").alias("name"), F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand")
    )
    return table(spark, d, "part").select("p_partkey", digests.canonical_digest(row, kind).alias("digest"))


@query("blind_ids", """
SELECT doc_id, 'review-' || substr(sha256('["blind-v1","' || doc_id || '"]'), 1, 16) AS blind_id FROM labels
""")
def blind_ids(spark, d):
    return table(spark, d, "labels").select("doc_id", digests.blind_id(F.col("doc_id").cast("string")).alias("blind_id"))


@query("payload_text", """
SELECT conv_id, turn, sha256('Translate.' || CASE WHEN role = 'user' THEN chr(10) || 'Use these terms.' || chr(10) || 'a = b' ELSE '' END
  || chr(10) || chr(10) || chr(10) || text) AS digest FROM conversations
""")
def payload_text(spark, d):
    glossary = F.when(F.col("role") == "user", F.lit("a = b"))
    content = reviews.payload_text(F.col("text"), F.lit("Translate."), F.lit("Use these terms."), glossary)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(content, 256).alias("digest"))


@query("format_flags", r"""
WITH o AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'Okay, let me Translate it: ' || text WHEN turn % 4 = 1 THEN 'リーグ・オブ・レジェンドの用語集' || text
   WHEN turn % 4 = 2 AND role = 'user' THEN '   ' ELSE text END AS output, turn % 3 = 0 AS done FROM conversations)
SELECT conv_id, turn, CASE WHEN done THEN NULL WHEN trim(output) = '' THEN 'blank'
  WHEN starts_with(output, 'Okay, ') AND contains(lower(substr(output, 1, 500)), 'translate') THEN 'explanation'
  WHEN starts_with(output, 'リーグ・オブ・レジェンドの用語集') THEN 'glossary' END AS flag FROM o
""")
def format_flags(spark, d):
    turn, text = F.col("turn"), F.col("text")
    output = (
        F.when(turn % 4 == 0, F.concat(F.lit("Okay, let me Translate it: "), text))
        .when(turn % 4 == 1, F.concat(F.lit(reviews.GLOSSARY_OPENING), text))
        .when((turn % 4 == 2) & (F.col("role") == "user"), F.lit("   ")).otherwise(text)
    )
    status = F.when(turn % 3 == 0, "human_confirmed").otherwise("unreviewed")
    return table(spark, d, "conversations").select("conv_id", "turn", reviews.format_flag(status, output).alias("flag"))


@query("term_check", """
WITH u AS (SELECT user_id, event_id % 50 AS part, list(DISTINCT event_type) AS s FROM events GROUP BY ALL)
SELECT user_id, part, (list_contains(s, 'click') OR list_contains(s, 'view')) AND list_contains(s, 'error') AS passed FROM u
""")
def term_check(spark, d):
    sets = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 50).alias("part")).agg(
        F.concat_ws(" ", F.array_sort(F.collect_set("event_type"))).alias("output")
    )
    groups = F.array(F.array(F.lit("click"), F.lit("view")), F.array(F.lit("error")))
    return sets.select("user_id", "part", reviews.term_check(F.col("output"), groups).alias("passed"))


@query("selection_check", """
WITH u AS (SELECT user_id, event_id % 50 AS part, list(DISTINCT event_type) AS s FROM events GROUP BY ALL)
SELECT user_id, part, list_contains(s, 'click') AND list_contains(s, 'view') AND NOT list_contains(s, 'error') AS passed,
  concat_ws(',', CASE WHEN NOT list_contains(s, 'click') THEN 'click' END, CASE WHEN NOT list_contains(s, 'view') THEN 'view' END) AS missing,
  CASE WHEN list_contains(s, 'error') THEN 'error' ELSE '' END AS forbidden_selected FROM u
""")
def selection_check(spark, d):
    sets = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 50).alias("part")).agg(F.collect_set("event_type").alias("s"))
    got = reviews.selection_check(F.col("s"), F.array(F.lit("view"), F.lit("click")), F.array(F.lit("error")))
    rows = sets.select("user_id", "part", got.alias("g"))
    return rows.select("user_id", "part", "g.passed", F.concat_ws(",", "g.missing").alias("missing"), F.concat_ws(",", "g.forbidden_selected").alias("forbidden_selected"))
