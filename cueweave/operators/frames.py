"""Frame and mask jobs: pixel expressions, and numpy kernels inside Arrow batches.

Pixels are 8-bit blue, green, red. Frames are rows, so they spread over tasks on their own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import spread
from .ordered import rows_of
from .tracking import detail_similarity, dilate, mask_similarity, pack_mask, unpack_mask

# Colour bounds of caption text (hue in 0..179) and shape limits of its components.
WHITE_MIN_VALUE, WHITE_MAX_SATURATION = 175, 120
YELLOW_HUE, YELLOW_MIN_SATURATION, YELLOW_MIN_VALUE = (8, 42), 65, 135
MASK_WIDTH = 320
PLAIN_WHITE, PLAIN_SPREAD = 170, 60
BAND = (10, 80)


# --- pixel expressions ---------------------------------------------------------------------


def hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Hue (0..179), saturation and value of 8-bit pixels, in the usual 12-bit fixed point."""
    value, low = F.greatest(b, g, r), F.least(b, g, r)
    spread = value - low
    fixed = lambda c: F.floor((c + 2048) / 4096).cast("int")
    saturation = F.when(value == 0, 0).otherwise(fixed(spread * F.round(F.lit(255 * 4096) / F.nullif(value, F.lit(0)))))
    sector = F.when(value == r, g - b).when(value == g, b - r + 2 * spread).otherwise(r - g + 4 * spread)
    hue = F.when(spread == 0, 0).otherwise(fixed(sector * F.round(F.lit(180 * 4096 / 6) / F.nullif(spread, F.lit(0)))))
    return F.when(hue < 0, hue + 180).otherwise(hue), saturation, value


def candidate_pixel(b: Column, g: Column, r: Column) -> Column:
    """Whether a pixel has the colour of caption text."""
    h, s, v = hsv(b, g, r)
    white = (v >= WHITE_MIN_VALUE) & (s <= WHITE_MAX_SATURATION)
    yellow = h.between(*YELLOW_HUE) & (s >= YELLOW_MIN_SATURATION) & (v >= YELLOW_MIN_VALUE)
    return white | yellow


def contrast(c: Column) -> Column:
    """One and a half times the contrast around the middle, cut to 0..255."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (c - 127.5) * 1.5 + 127.5))).cast("int")


def grayscale(b: Column, g: Column, r: Column) -> Column:
    """Luma with 15-bit weights."""
    return F.shiftright((3735 * b + 19235 * g + 9798 * r + 16384).cast("long"), 15).cast("int")


def white_mask(b: Column, g: Column, r: Column) -> Column:
    high, low = F.greatest(b, g, r), F.least(b, g, r)
    return F.when((low >= PLAIN_WHITE) & (high - low <= PLAIN_SPREAD), 255).otherwise(0)


def in_band(row: Column) -> Column:
    return (row >= BAND[0]) & (row < BAND[1])


def presence_score(text_pixels: Column, width: Column, height: Column, coverage: Column) -> Column:
    return F.least(F.lit(1.0), text_pixels / (width * height) * 18 + coverage * 0.8)


def otsu_thresholds(pixels: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """Otsu threshold of each image from its histogram (at most 256 levels per image)."""
    keys = list(keys)
    histogram = pixels.groupBy(*keys, F.col(level).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    mass = (F.col("level") * F.col("_n")).cast("double")
    sums = histogram.select(
        *keys, "level", F.sum("_n").over(upto).alias("n0"), F.sum(mass).over(upto).alias("s0"),
        F.sum("_n").over(whole).alias("n"), F.sum(mass).over(whole).alias("s"),
    ).filter("n0 < n")
    share = F.col("n0") / F.col("n")
    apart = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / (F.col("n") - F.col("n0"))
    scored = sums.withColumn("between_variance", share * (1 - share) * apart * apart)
    best = F.max_by(F.col("level"), F.struct("between_variance", -F.col("level")))
    return scored.groupBy(*keys).agg(best.alias("threshold"), F.max("between_variance").alias("between_variance"))


def binarize(level: Column, threshold: Column) -> Column:
    """Inverse binary: dark pixels become white."""
    return F.when(level > threshold, 0).otherwise(255)


# --- numpy kernels -------------------------------------------------------------------------


def image_of(row: dict) -> np.ndarray:
    return np.frombuffer(bytes(row["pixels"]), np.uint8).reshape(int(row["height"]), int(row["width"]), 3)


def candidate_mask(image: np.ndarray) -> np.ndarray:
    """The colour test of ``candidate_pixel`` for a whole image; only bright pixels are looked at."""
    brightest = np.maximum(np.maximum(image[..., 0], image[..., 1]), image[..., 2])
    bright = brightest >= min(WHITE_MIN_VALUE, YELLOW_MIN_VALUE)
    b, g, r = (image[..., i][bright].astype(np.int32) for i in range(3))
    value = brightest[bright].astype(np.int32)
    spread = value - np.minimum(np.minimum(b, g), r)
    per_value = np.rint(255 * 4096 / np.maximum(np.arange(256), 1)).astype(np.int32)
    per_spread = np.rint(180 * 4096 / 6 / np.maximum(np.arange(256), 1)).astype(np.int32)
    saturation = (spread * per_value[value] + 2048) >> 12
    sector = np.where(value == r, g - b, np.where(value == g, b - r + 2 * spread, r - g + 4 * spread))
    hue = np.where(spread == 0, 0, (sector * per_spread[spread] + 2048) >> 12)
    hue = np.where(hue < 0, hue + 180, hue)
    white = (value >= WHITE_MIN_VALUE) & (saturation <= WHITE_MAX_SATURATION)
    yellow = (hue >= YELLOW_HUE[0]) & (hue <= YELLOW_HUE[1]) & (saturation >= YELLOW_MIN_SATURATION) & (value >= YELLOW_MIN_VALUE)
    mask = np.zeros(image.shape[:2], bool)
    mask[bright] = white | yellow
    return mask


def components(mask: np.ndarray) -> pd.DataFrame:
    """Horizontal runs of a mask (y, x0, x1 exclusive) with the 8-connected component of each.

    Runs of neighbouring rows that touch are paired by two sorted lookups; labels then spread
    over the pairs, halving the way to the smallest one each round.
    """
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edges == 1)
    x1 = np.nonzero(edges == -1)[1]
    stride = w + 2
    low = np.searchsorted(y * stride + x1, (y + 1) * stride + x0, "left")
    high = np.searchsorted(y * stride + x0, (y + 1) * stride + x1, "right")
    touching = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(y)), touching)
    b = np.repeat(low - np.cumsum(touching) + touching, touching) + np.arange(len(a))
    label = np.arange(len(y))
    while len(a):
        smallest = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, label[a], smallest)
        np.minimum.at(fresh, label[b], smallest)
        fresh = fresh[fresh]
        if np.array_equal(fresh, label):
            break
        label = fresh
    return pd.DataFrame({"y": y, "x0": x0, "x1": x1, "label": label})


def _shapes(runs: pd.DataFrame) -> dict[str, np.ndarray]:
    """Bounding box, area and mean row of each component."""
    names, at = np.unique(runs.label.to_numpy(), return_inverse=True)
    y, x0, x1 = (runs[c].to_numpy() for c in ("y", "x0", "x1"))
    n = len(names)

    def least(values, start):
        out = np.full(n, start)
        np.minimum.at(out, at, values)
        return out

    left, right, top, bottom = least(x0, 1 << 30), -least(-x1, 1 << 30), least(y, 1 << 30), -least(-y, 1 << 30)
    area = np.bincount(at, x1 - x0, n)
    return {"label": names, "left": left, "right": right, "w": right - left, "h": bottom - top + 1, "area": area, "center": np.bincount(at, y * (x1 - x0), n) / area}


def text_mask(image: np.ndarray) -> tuple[np.ndarray, int]:
    """Mask of the row of caption-like components, grown by one pixel, and how many they are."""
    height, width = image.shape[:2]
    empty = np.zeros((height, width), bool)
    runs = components(candidate_mask(image))
    if runs.empty:
        return empty, 0
    shapes = _shapes(runs)
    lowest = max(4, round(height * 0.075))
    fits = (
        (shapes["h"] >= lowest) & (shapes["h"] <= height * 0.72) & (shapes["w"] >= 2)
        & (shapes["area"] >= max(8, round(width * height * 0.00012))) & (shapes["w"] <= width * 0.65)
    )
    if not fits.any():
        return empty, 0
    label, left, right, area, center = (shapes[c][fits] for c in ("label", "left", "right", "area", "center"))
    reach = max(lowest * 2, round(height * 0.16))

    def score(middle: float) -> tuple[float, float]:
        row = np.abs(center - middle) <= reach
        span = (right[row].max() - left[row].min()) / max(1, width)
        return float(area[row].sum() * (1 + span)), float(middle)

    middle = max(score(c) for c in np.unique(center))[1]
    chosen = label[np.abs(center - middle) <= reach]
    kept = runs[np.isin(runs.label.to_numpy(), chosen)]
    marks = np.zeros((height, width + 1), np.int32)
    np.add.at(marks, (kept.y.to_numpy(), kept.x0.to_numpy()), 1)
    np.add.at(marks, (kept.y.to_numpy(), kept.x1.to_numpy()), -1)
    return dilate(np.cumsum(marks, axis=1)[:, :width] > 0), len(chosen)


def gray_image(image: np.ndarray) -> np.ndarray:
    b, g, r = (image[..., i].astype(np.int64) for i in range(3))
    return (3735 * b + 19235 * g + 9798 * r + 16384) >> 15


def laplacian_variance(gray: np.ndarray) -> float:
    wide = np.pad(gray.astype(np.float64), 1, mode="reflect")
    return float((wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * wide[1:-1, 1:-1]).var())


def shrink(mask: np.ndarray, width: int = MASK_WIDTH) -> np.ndarray:
    """Nearest-neighbour reduction to at most ``width`` columns."""
    h, w = mask.shape
    if w <= width:
        return mask
    rows = max(1, round(h * width / w))
    ys = np.minimum((np.arange(rows) * (h / rows)).astype(int), h - 1)
    xs = np.minimum((np.arange(width) * (w / width)).astype(int), w - 1)
    return mask[ys][:, xs]


def feature_of(image: np.ndarray) -> dict:
    """Mask, presence, sharpness and counts of one line image."""
    height, width = image.shape[:2]
    if height < 2 or width < 2:
        raise ValueError("too few rows or columns for a line")
    mask, count = text_mask(image)
    pixels = int(mask.sum())
    columns = np.nonzero(mask.any(axis=0))[0]
    coverage = (int(columns[-1]) + 1 - int(columns[0])) / width if pixels else 0.0
    least = max(8, round(width * height * 0.00012))
    small = shrink(mask)
    return {
        "mask": pack_mask(small), "mask_w": small.shape[1], "mask_h": small.shape[0],
        "present": bool(pixels >= least * 2 and coverage >= 0.06 and (count >= 2 or coverage >= 0.18)),
        "presence": min(1.0, pixels / (width * height) * 18 + coverage * 0.8),
        "sharpness": laplacian_variance(gray_image(image)), "components": count, "text_pixels": pixels,
    }


def frame_features(frames: DataFrame, split_ratio: float | None = None) -> DataFrame:
    """Features of every line of every frame, frame-parallel."""
    ratio = None if split_ratio is None else float(split_ratio)
    if ratio is not None and not 0.1 <= ratio <= 0.9:
        raise ValueError("split ratio outside its bounds")

    def run(batches):
        for batch in batches:
            out = []
            for row in rows_of(batch):
                image = image_of(row)
                height = image.shape[0]
                cut = None if ratio is None else max(1, min(height - 1, round(height * ratio)))
                slices = [(0, height)] if cut is None else [(0, cut), (cut, height)]
                for index, (top, bottom) in enumerate(slices):
                    out.append({
                        "video_id": row["video_id"], "line_id": f"line-{index + 1}", "line_index": index, "ts": row["ts"],
                        "pts": row["ts"], "source_index": row["frame_id"], **feature_of(image[top:bottom]),
                    })
            yield pd.DataFrame(out, columns=names)

    names = [f.strip().split(" ")[0] for f in schemas.FEATURE.split(",")]
    return spread(frames).mapInPandas(run, schemas.FEATURE)


def otsu_image(gray: np.ndarray) -> np.ndarray:
    """Inverse binary image at the first level that separates dark and bright best, as ``otsu_thresholds``."""
    levels = np.arange(256)
    n0 = np.cumsum(np.bincount(gray.ravel(), minlength=256))
    s0 = np.cumsum(np.bincount(gray.ravel(), minlength=256) * levels)
    inside = (n0 > 0) & (n0 < n0[-1])
    if not inside.any():
        return np.where(gray > levels[0], 0, 255).astype(np.uint8)
    share = n0[inside] / n0[-1]
    apart = s0[inside] / n0[inside] - (s0[-1] - s0[inside]) / (n0[-1] - n0[inside])
    level = levels[inside][np.argmax(share * (1 - share) * apart * apart)]
    return np.where(gray > level, 0, 255).astype(np.uint8)


def preprocess(frames: DataFrame, mode: str) -> DataFrame:
    """Rewrite the pixels of every frame: contrast, grayscale, white_mask, band, otsu or raw."""
    kernels = {
        "raw": lambda i: i,
        "contrast": lambda i: np.clip((i.astype(np.float32) - 127.5) * 1.5 + 127.5, 0, 255).astype(np.uint8),
        "grayscale": lambda i: np.repeat(gray_image(i).astype(np.uint8)[..., None], 3, axis=2),
        "white_mask": lambda i: np.repeat(
            ((i.min(axis=2) >= PLAIN_WHITE) & (i.max(axis=2).astype(int) - i.min(axis=2) <= PLAIN_SPREAD)).astype(np.uint8)[..., None] * 255, 3, axis=2
        ),
        "vertical_band": lambda i: i[BAND[0] : BAND[1]],
        "otsu": lambda i: np.repeat(otsu_image(gray_image(i).astype(np.uint8))[..., None], 3, axis=2),
    }
    if mode not in kernels:
        raise ValueError(f"no such mode: {mode}")

    def run(batches):
        for batch in batches:
            images = [kernels[mode](image_of(row)) for row in rows_of(batch)]
            yield batch.assign(
                height=[i.shape[0] for i in images], width=[i.shape[1] for i in images], pixels=[np.ascontiguousarray(i).tobytes() for i in images]
            )

    return frames.mapInPandas(run, frames.schema)


def explode_pixels(frames: DataFrame) -> DataFrame:
    """One row per pixel: keys of the frame, y, x and the three channels."""
    byte = lambda at: F.conv(F.hex(F.substring("pixels", at + 1, F.lit(1))), 16, 10).cast("int")
    rest = [c for c in frames.columns if c != "pixels"]
    at = frames.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    i = F.col("_i")
    return at.select(
        *rest, F.floor(i / F.col("width")).cast("int").alias("y"), (i % F.col("width")).alias("x"),
        byte(i * 3).alias("b"), byte(i * 3 + 1).alias("g"), byte(i * 3 + 2).alias("r"),
    )


def _similarity(kernel):
    @F.pandas_udf(T.DoubleType())
    def run(a, b, width, height):
        pairs = zip(a, b, width, height)
        return pd.Series([
            None if x is None or y is None else float(kernel(unpack_mask(bytes(x), int(w), int(h)), unpack_mask(bytes(y), int(w), int(h))))
            for x, y, w, h in pairs
        ])

    return run


def mask_overlap(a: Column, b: Column, width: Column, height: Column) -> Column:
    """Tolerant overlap of two packed masks (Arrow batch)."""
    return _similarity(mask_similarity)(a, b, width, height)


def dice_shift(a: Column, b: Column, width: Column, height: Column) -> Column:
    """Best Dice overlap over the nine one-pixel shifts of two packed masks (Arrow batch)."""
    return _similarity(detail_similarity)(a, b, width, height)
