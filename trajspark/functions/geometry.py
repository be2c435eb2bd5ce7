"""Boxes as array<double> [x1, y1, x2, y2]; every function maps columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share, 0 if they are apart."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    return side(0) * side(1)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is not positive."""
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def iou_strict(a: Column, b: Column) -> Column:
    """As iou, but 0 as soon as the boxes are apart, and no guard on the union."""
    both = overlap(a, b)
    return F.when(both <= 0, F.lit(0.0)).otherwise(both / (area(a) + area(b) - both))


def gt_coverage(box: Column, gt: Column) -> Column:
    """Share of gt that the box covers; 0 for a gt without area."""
    return F.when(area(gt) > 0, overlap(box, gt) / area(gt)).otherwise(F.lit(0.0))


def xywh_to_xyxy(b: Column) -> Column:
    return F.array(b[0], b[1], b[0] + b[2], b[1] + b[3])


def norm_box(b: Column, w: Column, h: Column) -> Column:
    return F.array(b[0] / w, b[1] / h, b[2] / w, b[3] / h)


def denorm_box(b: Column, w: Column, h: Column) -> Column:
    return F.array(b[0] * w, b[1] * h, b[2] * w, b[3] * h)


def norm_if_pixel(b: Column, w: Column, h: Column) -> Column:
    """Normalised if any coordinate is over 1; boxes of another length and boxes with nulls stay as they are."""
    pixel = (F.size(b) == 4) & F.exists(b, lambda x: x > 1) & ~F.exists(b, lambda x: x.isNull())
    return F.when(pixel, norm_box(b, w, h)).otherwise(b)


def clamp_box(b: Column, w: Column, h: Column) -> Column:
    """Cut to whole pixels inside the image (truncation towards zero)."""
    fit = lambda x, most: F.greatest(F.lit(0).cast("long"), F.least(x.cast("long"), most.cast("long")))
    return F.array(fit(b[0], w), fit(b[1], h), fit(b[2], w), fit(b[3], h))


def empty_box(b: Column) -> Column:
    return (b[2] <= b[0]) | (b[3] <= b[1])


def full_image(b: Column, w: Column, h: Column) -> Column:
    """Whether the box covers [0, 0, w-1, h-1]."""
    return (b[0] <= 0) & (b[1] <= 0) & (b[2] >= w - 1) & (b[3] >= h - 1)


def map_box(b: Column, sx: Column, sy: Column, w: Column, h: Column) -> Column:
    """Scaled, truncated and clipped to the image."""
    return clamp_box(F.array(b[0] * sx, b[1] * sy, b[2] * sx, b[3] * sy), w, h)


def view_chain_map(b: Column, windows: Column) -> Column:
    """A box given inside the innermost of nested windows (outermost first), in coordinates of the whole image."""
    unwrap = lambda acc, v: F.array(v[0] + acc[0] * (v[2] - v[0]), v[1] + acc[1] * (v[3] - v[1]), v[0] + acc[2] * (v[2] - v[0]), v[1] + acc[3] * (v[3] - v[1]))
    return F.aggregate(F.reverse(windows), b, unwrap)


def view_chain_map_as_coded(b: Column, windows: Column) -> Column:
    """The chain as the scoring scripts run it: at the innermost window a side is divided by the window's side before it is
    scaled, so the box shrinks towards the window's corner."""
    inner = F.element_at(windows, -1)
    shrunk = F.array(b[0] / (inner[2] - inner[0]), b[1] / (inner[3] - inner[1]), b[2] / (inner[2] - inner[0]), b[3] / (inner[3] - inner[1]))
    return F.when(F.size(windows) > 0, view_chain_map(shrunk, windows)).otherwise(b)


def smart_resize(w: Column, h: Column, factor: int = 28, least: int = 3136, most: int = 12845056) -> Column:
    """struct(w, h): sides as multiples of factor (rounded half to even) with the pixel count between least and most."""
    fit = lambda x: F.greatest(F.lit(float(factor)), F.bround(x / factor) * factor)
    rw, rh = fit(w), fit(h)
    down, up = F.sqrt(w * h / float(most)), F.sqrt(float(least) / (w * h))
    shrink = lambda x: F.greatest(F.lit(float(factor)), F.floor(x / down / factor) * factor)
    grow = lambda x: F.ceil(x * up / factor) * factor
    pick = lambda r, x: F.when(rw * rh > most, shrink(x)).when(rw * rh < least, grow(x)).otherwise(r).cast("long")
    return F.struct(pick(rw, w).alias("w"), pick(rh, h).alias("h"))


def display_size(w: Column, h: Column, longest: int = 1024) -> Column:
    """struct(w, h): shrunk so that the longest side fits, truncated, at least 1."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(w, h))
    fit = lambda x: F.greatest(F.lit(1).cast("long"), (x * scale).cast("long"))
    return F.struct(fit(w).alias("w"), fit(h).alias("h"))
