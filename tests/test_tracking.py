"""Tracker goldens on small masks, batch against stream, and frame features."""

import random

import numpy as np
import pytest

from cueweave import schemas
from cueweave.operators import frames as fr, tracking as tk
from cueweave.streaming import stateful

H, W = 20, 60


def boxes(*rects):
    mask = np.zeros((H, W), bool)
    for y, x, h, w in rects:
        mask[y : y + h, x : x + w] = True
    return mask


A = boxes((4, 4, 8, 10), (4, 20, 8, 10))
B = boxes((10, 40, 8, 12), (2, 34, 6, 8))
STRIPES = boxes(*[(4, x, 8, 1) for x in range(4, 40, 4)])
SHIFTED = boxes(*[(4, x, 8, 1) for x in range(6, 42, 4)])
NONE = boxes()


def feature(ts, mask, video="v", line="line-1"):
    present = bool(mask.any())
    return (video, line, 0, ts, ts, int(round(ts * 5)), tk.pack_mask(mask), W, H, present, 0.5, 100.0, 2, int(mask.sum()))


def track(spark, masks, minimum=0.4, step=0.2, size=20_000, end=None):
    rows = [feature(round(i * step, 1), m) for i, m in enumerate(masks)]
    out = tk.track_intervals(spark.createDataFrame(rows, schemas.FEATURE), tk.TrackerConfig(minimum), end or len(masks) * step, size)
    return sorted(out.collect(), key=lambda r: (r.start_seconds, r.kind))


def brief(rows):
    return [(r.kind, round(r.start_seconds, 2), round(r.end_seconds, 2), r.start_reason, r.end_reason or r.dropped_reason) for r in rows]


def test_first_sample_is_the_boundary(spark):
    got = track(spark, [NONE, A, A, A, A, NONE, NONE, NONE])
    assert brief(got) == [("interval", 0.2, 1.0, "appearance_confirmed", "disappearance_confirmed")]
    assert got[0].sample_count == 4 and got[0].median_similarity == 1.0 and len(got[0].candidates) == 3
    assert got[0].representative_ts == 0.2


def test_one_odd_sample_is_ignored(spark):
    assert brief(track(spark, [A, A, A, B, A, A, A])) == [("interval", 0.0, 1.4, "appearance_confirmed", "range_end")]
    assert brief(track(spark, [A, A, A, NONE, A, A])) == [("interval", 0.0, 1.2, "appearance_confirmed", "range_end")]


def test_change_detail_change_and_tail(spark):
    assert brief(track(spark, [A, A, A, B, B, B])) == [
        ("interval", 0.0, 0.6, "appearance_confirmed", "change_confirmed"), ("interval", 0.6, 1.2, "change_confirmed", "range_end"),
    ]
    assert tk.mask_similarity(STRIPES, SHIFTED) < 0.68 or tk.detail_similarity(STRIPES, SHIFTED) < 0.65
    moved = boxes((4, 4, 8, 10), (4, 20, 8, 3), (4, 26, 8, 4))
    assert tk.mask_similarity(A, moved) >= 0.68
    dots = boxes(*[(y, x, 1, 1) for y in range(4, 12, 2) for x in range(4, 40, 2)])
    other = boxes(*[(y + (x % 4) // 2, x + 1 - (y % 4) // 2, 1, 1) for y in range(4, 12, 2) for x in range(4, 40, 2)])
    assert tk.mask_similarity(dots, other) >= 0.68 and tk.detail_similarity(dots, other) < 0.65
    assert brief(track(spark, [dots, dots, dots, other, other, other, other])) == [
        ("interval", 0.0, 0.6, "appearance_confirmed", "detail_change_confirmed"), ("interval", 0.6, 1.4, "detail_change_confirmed", "range_end"),
    ]
    two = track(spark, [dots, dots, dots, other, other])
    assert brief(two) == [("interval", 0.0, 1.0, "appearance_confirmed", "range_end_with_unconfirmed_transition")] and two[0].needs_review
    assert brief(track(spark, [NONE, NONE, A])) == [("dropped", 0.4, 0.6, None, "appearance_not_confirmed")]
    assert brief(track(spark, [A, A, NONE, NONE], minimum=0.6)) == [("dropped", 0.0, 0.4, None, "shorter_than_minimum_duration")]


def random_masks(seed, n):
    rng = random.Random(seed)
    out, current = [], A
    for _ in range(n):
        if rng.random() < 0.3:
            current = rng.choice([A, B, STRIPES, SHIFTED, NONE])
        out.append(current if rng.random() < 0.85 else rng.choice([A, B, NONE]))
    return out


def test_slices_do_not_change_the_result(spark):
    masks = random_masks(1, 90)
    assert brief(track(spark, masks, size=8)) == brief(track(spark, masks))


def test_similarities():
    assert tk.mask_similarity(NONE, NONE) == 1.0 and tk.mask_similarity(A, NONE) == 0.0 and tk.detail_similarity(A, A) == 1.0
    shifted = np.roll(A, 1, axis=1)
    assert tk.mask_similarity(A, shifted) == 1.0 and tk.detail_similarity(A, shifted) == 1.0
    assert tk.detail_similarity(A, np.roll(A, 3, axis=1)) < 1.0
    assert (tk.unpack_mask(tk.pack_mask(B), W, H) == B).all()


def stream_files(spark, rows, schema, folder, parts):
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/p{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def drain(spark, df, name, folder):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp-{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name).collect()


def test_equal_masks_are_told_without_the_kernels(monkeypatch):
    monkeypatch.setattr(tk, "dilate", None)
    for mask in (A, NONE, STRIPES):
        assert tk.mask_similarity(mask, mask.copy()) == 1.0 and tk.detail_similarity(mask, mask.copy()) == 1.0


def test_stream_equals_batch(spark, folder):
    masks = random_masks(7, 40)
    rows = [feature(round(i * 0.2, 1), m) for i, m in enumerate(masks)]
    # A later sample of another video moves the watermark past the idle timer of the first.
    rows += [feature(10_000.0, A, "clock"), feature(20_000.0, A, "clock")]
    stream = stream_files(spark, rows, schemas.FEATURE, f"{folder}/in", 6)
    out = stateful.track_intervals_stream(stream, tk.TrackerConfig(0.4), range_end=8.0, delay="1 seconds", idle_ms=5_000)
    got = [r for r in drain(spark, out, "tracked", folder) if r.video_id == "v"]
    assert brief(sorted(got, key=lambda r: (r.start_seconds, r.kind))) == brief(track(spark, masks, end=8.0))


def test_runs_stream_and_late_rows(spark, folder):
    text = ["가", "가", "나", " ", "나", "나"]
    rows = [("v", "line-1", i * 0.2, "subtitle", t, [], 0.5, None) for i, t in enumerate(text)]
    rows += [("v", "line-1", 0.1, "subtitle", "늦음", [], 0.5, None), ("w", "line-1", 9_000.0, "subtitle", "끝", [], 0.5, None), ("w", "line-1", 9_900.0, "subtitle", "끝", [], 0.5, None)]
    stream = stream_files(spark, rows, schemas.SAMPLE, f"{folder}/in", len(rows))
    out = stateful.merge_runs_stream(stream, 0.2, delay="100 seconds", idle_ms=5_000)
    found = [r for r in drain(spark, out, "runs", folder) if r.video_id == "v"]
    assert all(r.raw_lines == [r.raw_text] and r.source_ko == r.raw_text for r in found if r.kind == "caption")
    got = sorted((r.kind, round(r.start_seconds, 1), round(r.end_seconds, 1), r.raw_text) for r in found)
    assert got == [("caption", 0.0, 0.4, "가"), ("caption", 0.4, 0.6, "나"), ("caption", 0.8, 1.2, "나"), ("late", 0.1, 0.1, None)]


def test_window_streams(spark, folder):
    rows = [("v", round(i * 0.05, 2), i) for i in range(20)] + [("v", 500.0, 99)]
    schema = "video_id string, ts double, n int"
    stream = stream_files(spark, rows, schema, f"{folder}/in", 3)
    first = drain(spark, stateful.interval_sample_stream(stream, ("video_id",), 200), "first", folder)
    assert sorted(r.n for r in first) == [0, 4, 8, 12, 16]
    sessions = drain(spark, stateful.sessions_stream(stream, ("video_id",), "30 seconds"), "sessions", folder)
    assert [r.rows for r in sessions] == [20]
    with pytest.raises(ValueError):
        stateful.interval_sample_stream(stream, ("video_id",), 20)


def caption_image(color, background=(20, 20, 20), h=80, w=400, glyphs=8):
    image = np.full((h, w, 3), background, np.uint8)
    for i in range(glyphs):
        x = 60 + i * 32
        image[30:54, x : x + 6] = color
        image[30:36, x : x + 22] = color
    return image


def frame_row(image, i=0):
    return ("v", i, i * 0.2, image.shape[1], image.shape[0], image.tobytes())


def test_frame_features(spark):
    white, yellow, dark, red = caption_image((255, 255, 255)), caption_image((0, 220, 255)), caption_image((90, 90, 90)), caption_image((0, 0, 255))
    speck = np.full((80, 400, 3), 20, np.uint8)
    speck[40:42, 10:12] = 255
    df = spark.createDataFrame([frame_row(im, i) for i, im in enumerate([white, yellow, dark, red, speck])], schemas.FRAME)
    got = {r.source_index: r for r in fr.frame_features(df).collect()}
    assert [got[i].present for i in range(5)] == [True, True, False, False, False]
    assert got[0].components == 8 and got[0].mask_w == 320 and got[0].mask_h == 64 and got[0].text_pixels == got[1].text_pixels
    assert got[0].sharpness > 0 and 0 < got[0].presence <= 1
    halves = fr.frame_features(df, 0.3).collect()
    assert {(r.source_index, r.line_id): r.present for r in halves}[(0, "line-2")] and len(halves) == 10


def flood(mask):
    seen, sizes = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        stack, size = [(y, x)], 0
        seen[y, x] = True
        while stack:
            cy, cx = stack.pop()
            size += 1
            for ny in range(max(0, cy - 1), min(mask.shape[0], cy + 2)):
                for nx in range(max(0, cx - 1), min(mask.shape[1], cx + 2)):
                    if mask[ny, nx] and not seen[ny, nx]:
                        seen[ny, nx] = True
                        stack.append((ny, nx))
        sizes.append(size)
    return sorted(sizes)


def test_components_equal_flood_fill():
    rng = np.random.default_rng(4)
    for density in (0.1, 0.3, 0.45, 0.6, 0.9):
        mask = rng.random((23, 31)) < density
        runs = fr.components(mask)
        assert sorted((runs.x1 - runs.x0).groupby(runs.label).sum().tolist()) == flood(mask)


def test_pixel_columns_equal_kernels(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (12, 20, 3), dtype=np.uint8)
    frames = spark.createDataFrame([frame_row(image)], schemas.FRAME)
    from pyspark.sql import functions as F

    b, g, r = F.col("b"), F.col("g"), F.col("r")
    cells = fr.explode_pixels(frames).select("y", "x", fr.candidate_pixel(b, g, r).alias("c"), fr.contrast(b).alias("k"), fr.grayscale(b, g, r).alias("gray"), fr.white_mask(b, g, r).alias("w")).collect()
    mask = fr.candidate_mask(image)
    out = {m: np.frombuffer(bytes(fr.preprocess(frames, m).first().pixels), np.uint8).reshape(12, 20, 3) for m in ("contrast", "grayscale", "white_mask")}
    for c in cells:
        assert c.c == mask[c.y, c.x] and c.k == out["contrast"][c.y, c.x, 0] and c.gray == out["grayscale"][c.y, c.x, 0] and c.w == out["white_mask"][c.y, c.x, 0]
    band = fr.preprocess(spark.createDataFrame([frame_row(caption_image((255, 255, 255), h=96))], schemas.FRAME), "vertical_band").first()
    assert band.height == 70


def test_median_of_counted_similarities_and_size_of_the_state():
    import pickle
    import statistics

    rng = random.Random(3)
    for n in [*range(1, 12), 500]:
        seen = [rng.choice([0.7, 0.8, 0.9, 0.95, rng.random()]) for _ in range(n)]
        shown = tk.Shown(None, "r")
        for value in seen:
            shown.similarities[value] = shown.similarities.get(value, 0) + 1
        assert shown.median_similarity() == statistics.median(seen)
    assert tk.Shown(None, "r").median_similarity() is None
    line, sizes = tk.Line(), []
    for i in range(20_000):
        row = dict(zip(schemas_names(), feature(i * 0.2, A)))
        assert tk.step(line, tk.observation(row), tk.TrackerConfig()) == []
        if i in (100, 19_999):
            sizes.append(len(pickle.dumps(line, protocol=5)))
    assert sizes[1] <= sizes[0] + 16


def schemas_names():
    return [f.split()[0] for f in schemas.FEATURE.split(", ")]
