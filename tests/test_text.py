"""Scalar goldens: normalisation, tokens, variants, geometry, captions, digests."""

import hashlib
import json
import unicodedata

from pyspark.sql import Row, functions as F
from pyspark.sql import types as T

from cueweave.functions import captions as cap, digests, geometry as geo, text as tx


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normal_forms(spark):
    nfd = unicodedata.normalize("NFD", "가 나 다 é\x1c!")
    (got,) = values(spark, [(nfd,)], "t string", tx.normalize_for_comparison("t"))
    assert got == ("가나다é!",)
    (got,) = values(spark, [("a\r\nb\rc\n가",)], "t string", tx.normalize_text("t"))
    assert got == ("a\nb\nc\n가",)
    (got,) = values(spark, [("  STRASSE Straße ΑΣ ",)], "t string", tx.dictionary_key("t"))
    assert got == ("  STRASSE Straße ΑΣ ".casefold().strip(),)
    (got,) = values(spark, [(None,)], "t string", tx.nfc("t"), tx.dictionary_key("t"))
    assert got == (None, None)
    (got,) = values(spark, [("　<b>이름</b><br>뒤 ",)], "t string", tx.clean_name("t"))
    assert got == ("이름뒤",)


def test_low_information(spark):
    rows = [("드래곤", 0.5), ("드래곤", 0.49), ("드래곤", None), ("ab", 0.6), ("ab", 0.59), ("a", 0.9), ("", 0.9)]
    got = values(spark, rows, "t string, c double", tx.is_low_information("t", "c"))
    assert [g[0] for g in got] == [False, True, True, False, True, True, True]


def test_tokens(spark):
    (got,) = values(spark, [("q가 Wr 12.5초 R e3 3:10",)], "t string", tx.protected_tokens("t"), tx.number_tokens("t"), tx.slot_tokens("t"))
    assert got == (["q", "Wr", "12.5", "R", "e", "3", "3:10"], ["12.5", "3", "3:10"], ["Q", "R", "E"])


def test_variants(spark):
    rows = [
        ("드래곤 나왔다", "드래곤나왔다"),      # equal without blanks
        ("바론 먹었어요 지금", "바론 먹었어오 지금"),  # one edit of eight
        ("3분 뒤에 용", "4분 뒤에 용"),         # numbers differ
        ("큐 맞았다", "정글 갔다"),             # different text
        ("드래곤", "바론"),
    ]
    got = values(spark, rows, "a string, b string", tx.conservative_variants("a", "b"), tx.temporal_variants("a", "b"))
    assert got[0] == (True, True) and got[1] == (True, True)
    assert got[2] == (False, False) and got[3] == (False, False) and got[4] == (False, False)
    loose = [("Q 사용했습니다", "사용했슴니다"), ("Q 사용했습니다", "W 사용했슴니다"), ("안녕하세요 여러분", "안넝하세오 여러")]
    got = values(spark, loose, "a string, b string", tx.conservative_variants("a", "b"), tx.temporal_variants("a", "b"))
    assert got == [(False, True), (False, False), (False, True)]


def test_row_metrics(spark):
    m = tx.row_metrics("a", "b")
    got = values(spark, [("가 나다", "가나라"), ("가", None), ("", "x")], "a string, b string", *m.values())
    assert got[0] == (2, 4, 0.5, 1, 3, 1 / 3, False)
    assert got[1] == (1, 1, 1.0, 1, 1, 1.0, False)
    assert got[2][2] is None and got[2][5] is None


def test_geometry(spark):
    c = [F.col(n) for n in "xywh"]
    rows = [(0.1, 0.2, 0.5, 0.3), (0.6, 0.0, 0.4 + 5e-10, 1.0), (0.6, 0.0, 0.41, 1.0), (0.0, 0.0, 0.0001, 0.5), (float("nan"), 0.0, 0.5, 0.5)]
    got = values(spark, rows, "x double, y double, w double, h double", geo.region_valid(*c), geo.region_to_pixels(*c, F.lit(100), F.lit(50)))
    assert [g[0] for g in got] == [True, True, False, True, False]
    assert got[0][1] == Row(left=10, top=10, width=50, height=15) and got[3][1] is None
    (got,) = values(spark, [(0.1, 0.9, 0.333, 0.1)], "x double, y double, w double, h double", geo.crop_pixels_even(*c, F.lit(101), F.lit(51)))
    assert got[0] == Row(x=10, y=46, width=34, height=4)
    rows = [(10, None), (10, 0.25), (1, 0.5), (10, 0.95)]
    got = [[tuple(s) for s in g[0]] if g[0] else None for g in values(spark, rows, "h int, r double", geo.line_slices(F.col("h"), F.col("r")))]
    assert got[0] == [("line-1", 0, 0, 10)] and got[1] == [("line-1", 0, 0, 2), ("line-2", 1, 2, 10)] and got[3] is None
    (got,) = values(spark, [(1.0,)], "t double", geo.sample_grid(F.col("t"), F.lit(3.0), F.lit(2)), geo.sample_grid(F.col("t"), F.lit(3.0), F.lit(0)))
    assert got == ([2.5, 5.5], [])


def test_resolve_range(spark):
    rows = [("whole", None, None, 9.0), ("range", 1.0, 9.04, 9.0), ("range", 9.0, 9.5, 9.0), ("range", 1.0, 9.1, 9.0), ("whole", None, None, 0.0)]
    got = values(spark, rows, "m string, s double, e double, d double", geo.resolve_range(F.col("m"), F.col("s"), F.col("e"), F.col("d")))
    assert [(g[0].start, g[0].end) for g in got] == [(0.0, 9.0), (1.0, 9.0), (None, None), (None, None), (None, None)]
    assert [g[0].error is None for g in got] == [True, True, False, False, False]


CAPTION = (
    "c struct<corrected_ko:string,ocr:struct<raw_text:string>,translation:struct<status:string,source_ko:string,"
    "generated_ja:string,user_ja:string,error:string>>"
)


def caption(status="completed", source="원문", generated="訳", user=None, corrected=None):
    return ((corrected, ("원문",), (status, source, generated, user, None)),)


def test_caption_edits(spark):
    df = spark.createDataFrame([caption()], CAPTION)
    edit = lambda c, t: cap.with_user_edit(c, F.lit(t))
    stale = df.select(edit(F.col("c"), "고침").alias("c"))
    assert stale.first().c.translation.status == "stale"
    back = stale.select(edit(F.col("c"), "  ").alias("c")).first().c
    assert back.translation.status == "completed" and back.corrected_ko is None
    none = spark.createDataFrame([caption("stale", "원문", None)], CAPTION).select(edit(F.col("c"), "").alias("c")).first().c
    assert none.translation.status == "pending"
    made = spark.createDataFrame([caption("pending", "x", None, "手動")], CAPTION).select(cap.with_generated(F.col("c"), F.lit(" 新 ")).alias("c")).first().c.translation
    assert (made.generated_ja, made.status, made.user_ja, made.source_ko) == ("新", "completed", "手動", "원문")
    user = df.select(cap.with_user_translation(F.col("c"), F.lit("")).alias("c")).first().c.translation
    assert user.user_ja is None


def test_digests(spark):
    kind = T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.MapType(T.StringType(), T.StringType()))])
    df = spark.createDataFrame([((1, {"y": "2", "x": "가"}),), ((None, {}),)], T.StructType([T.StructField("s", kind)]))
    got = [r[0] for r in df.select(digests.canonical_digest(F.col("s"), kind)).collect()]
    want = [{"b": 1, "a": {"y": "2", "x": "가"}}, {"b": None, "a": {}}]
    assert got == [hashlib.sha256(json.dumps(w, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for w in want]
    df = spark.createDataFrame([('r"1\n',)], "id string")
    body = json.dumps(["blind-v1", 'r"1\n'], separators=(",", ":"))
    assert df.select(digests.blind_id(F.col("id"))).first()[0] == "review-" + hashlib.sha256(body.encode()).hexdigest()[:16]
