"""Rectangles as column expressions: regions are structs of x, y, width, height in fractions of a frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import half_up

EPS = 1e-9


def clamp(c: Column, low: Column | float, high: Column | float) -> Column:
    wrap = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(wrap(high), F.greatest(wrap(low), c))


def region(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def move_region(r: Column, dx: Column, dy: Column, snap: float = 0.0) -> Column:
    """Moved within the frame; a middle within `snap` of the frame's is put there, for each axis by itself."""

    def axis(at: Column, size: Column, d: Column) -> Column:
        to = clamp(at + d, 0.0, 1 - size)
        return F.when(F.abs(to + size / 2 - 0.5) <= snap, 0.5 - size / 2).otherwise(to) if snap else to

    return region(axis(r["x"], r["width"], dx), axis(r["y"], r["height"], dy), r["width"], r["height"])


def resize_region(r: Column, corner: str, dx: Column, dy: Column, least_width: float, least_height: float) -> Column:
    """One corner (nw, ne, sw, se) moved, the opposite one staying where it is."""

    def axis(at: Column, size: Column, d: Column, low_moves: bool, least: float) -> tuple[Column, Column]:
        end = at + size
        if low_moves:
            to = clamp(at + d, 0.0, end - least)
            return to, end - to
        return at, clamp(end + d, at + least, 1.0) - at

    x, w = axis(r["x"], r["width"], dx, "w" in corner, least_width)
    y, h = axis(r["y"], r["height"], dy, "n" in corner, least_height)
    return region(x, y, w, h)


def resize_from_center(r: Column, dx: Column, dy: Column, least_width: float, least_height: float) -> Column:
    """Both sides moved alike, the middle staying; no further than the nearer edge of the frame."""

    def axis(at: Column, size: Column, d: Column, least: float) -> tuple[Column, Column]:
        middle = at + size / 2
        limit = 2 * F.least(middle, 1 - middle)
        new = clamp(size + 2 * d, F.least(F.lit(least), limit), limit)
        return middle - new / 2, new

    x, w = axis(r["x"], r["width"], dx, least_width)
    y, h = axis(r["y"], r["height"], dy, least_height)
    return region(x, y, w, h)


def crop_rectangle(r: Column, width: Column, height: Column) -> Column:
    """Pixels of a region: at least one, within the frame."""
    x, y = half_up(r["x"] * width), half_up(r["y"] * height)
    w = F.greatest(F.lit(1), F.least(width - x, half_up(r["width"] * width)))
    h = F.greatest(F.lit(1), F.least(height - y, half_up(r["height"] * height)))
    return F.struct(*(c.cast("int").alias(n) for n, c in (("x", x), ("y", y), ("width", w), ("height", h))))


def detector_size(width: Column, height: Column) -> Column:
    """Input of the detector: at most 1536 long, both sides multiples of 32."""
    scale = F.least(F.lit(1.0), 1536 / F.greatest(width, height))
    side = lambda c: F.greatest(F.lit(32), half_up(c * scale / 32) * 32).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def reduced_size(width: Column, height: Column) -> Column:
    """Raster of signatures and masks: at most 1024 by 256."""
    scale = F.least(F.lit(1.0), 1024 / width, 256 / height)
    side = lambda c: F.greatest(F.lit(1), half_up(c * scale)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def to_frame(lines: Column, outer: Column) -> Column:
    """Lines with boxes in fractions of a crop, given in fractions of the frame that the crop is a region of."""

    def moved(x: Column) -> Column:
        b = x["box"]
        return x.withField("box", region(outer["x"] + b["x"] * outer["width"], outer["y"] + b["y"] * outer["height"], b["width"] * outer["width"], b["height"] * outer["height"]))

    return F.transform(lines, moved)


def saved_region(r: Column) -> Column:
    """A stored region if it lies in the frame and has a size, what juts out by rounding cut off; else null."""
    good = (r["x"] >= 0) & (r["y"] >= 0) & (r["width"] > 0) & (r["height"] > 0) & (r["x"] + r["width"] <= 1 + EPS) & (r["y"] + r["height"] <= 1 + EPS)
    return F.when(good, region(r["x"], r["y"], F.least(r["width"], 1 - r["x"]), F.least(r["height"], 1 - r["y"])))


def large_enough(r: Column, width: Column, height: Column, start: Column) -> Column:
    """Whether a region is 16 by 8 pixels at least and its time isn't negative."""
    return (start >= 0) & (r["width"] * width >= 16) & (r["height"] * height >= 8)


def pointer_mode(button: Column, ctrl: Column, meta: Column, selecting: Column, on_corner: Column) -> Column:
    """What a press does: nothing unless it is of the main button (or of the second with Control); a new selection while selecting, a resize
    from the middle with a key, a resize at a corner, else a move."""
    off = (button != 0) & ~((button == 2) & ctrl)
    return F.when(off, None).when(selecting, "select").when(ctrl | meta, "center").when(on_corner, "resize").otherwise("move")
