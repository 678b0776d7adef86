"""Regions, pixel rectangles, line slices and analysis ranges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EDGE_TOLERANCE = 1e-9


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def region_valid(x: Column, y: Column, width: Column, height: Column) -> Column:
    """A finite rectangle with area that lies inside the unit square."""
    finite = _finite(x) & _finite(y) & _finite(width) & _finite(height)
    inside = (x + width <= 1 + EDGE_TOLERANCE) & (y + height <= 1 + EDGE_TOLERANCE)
    return finite & (x >= 0) & (y >= 0) & (width > 0) & (height > 0) & inside


def _half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("int")


def region_to_pixels(x: Column, y: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    """Pixel rectangle from rounding each edge half up; null when invalid or empty."""
    left, top = _half_up(x * w), _half_up(y * h)
    right, bottom = _half_up((x + width) * w), _half_up((y + height) * h)
    bounded = region_valid(x, y, width, height) & (x <= 1) & (y <= 1) & (width <= 1) & (height <= 1)
    return F.when(
        bounded & (right > left) & (bottom > top),
        F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height")),
    )


def _even(c: Column) -> Column:
    return c - F.pmod(c, F.lit(2))


def _half_even(c: Column) -> Column:
    return F.bround(c).cast("int")


def crop_pixels_even(x: Column, y: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    """Crop rectangle with even origin and size, at least two pixels on each side."""

    def axis(start: Column, extent: Column, size: Column) -> tuple[Column, Column]:
        origin = _even(F.greatest(F.lit(0), F.least(size - 2, _half_even(start * size))))
        stop = F.greatest(origin + 2, F.least(size, _half_even((start + extent) * size)))
        return origin, F.greatest(F.lit(2), _even(stop - origin))

    left, crop_width = axis(x, width, w)
    top, crop_height = axis(y, height, h)
    return F.struct(
        left.alias("x"), top.alias("y"), crop_width.alias("width"), crop_height.alias("height")
    )


def resolve_range(mode: Column, start: Column, end: Column, duration: Column) -> Column:
    """Resolved ``start``/``end`` with an ``error`` text; exactly one side is filled."""
    whole = mode == "whole"
    error = (
        F.when(~_finite(duration) | (duration <= 0), "range.duration")
        .when(whole, F.lit(None))
        .when(start >= duration, "range.start")
        .when(end > duration + F.lit(0.05), "range.end")
    )
    usable = error.isNull()
    return F.struct(
        F.when(usable, F.when(whole, F.lit(0.0)).otherwise(start)).alias("start"),
        F.when(usable, F.when(whole, duration).otherwise(F.least(end, duration))).alias("end"),
        error.alias("error"),
    )


def line_slices(height: Column, split_ratio: Column) -> Column:
    """Array of line slices: one without a ratio, else two that meet at the split row.

    Null for a height below one or a ratio outside 0.1 .. 0.9.
    """
    split = F.greatest(F.lit(1), F.least(height - 1, _half_even(height * split_ratio)))

    def slice_of(line: str, index: int, top: Column, bottom: Column) -> Column:
        return F.struct(
            F.lit(line).alias("line_id"),
            F.lit(index).alias("line_index"),
            top.cast("int").alias("top"),
            bottom.cast("int").alias("bottom"),
        )

    return F.when(
        (height > 0) & split_ratio.isNull(), F.array(slice_of("line-1", 0, F.lit(0), height))
    ).when(
        (height > 0) & split_ratio.between(0.1, 0.9),
        F.array(slice_of("line-1", 0, F.lit(0), split), slice_of("line-2", 1, split, height)),
    )


def sample_grid(start: Column, interval: Column, n: Column) -> Column:
    """Array of bucket-centre times ``start + interval/2 + i*interval`` for i in 0..n-1."""
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: start + interval / 2 + i * interval)


def frame_offsets(t: Column, fps: Column) -> Column:
    """The frame before, at and after ``t``; the middle one is primary."""
    return F.transform(
        F.array(F.lit(-1), F.lit(0), F.lit(1)),
        lambda step: F.struct(
            (step + 2).alias("frame"), (t + step / fps).alias("ts"), (step == 0).alias("primary")
        ),
    )
