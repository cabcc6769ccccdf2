"""Output sizes and rectangles.  ``round`` is half away from zero, ``cast`` to int truncates toward zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column) -> Column:
    return F.round(x).try_cast("int")


def rect(left: Column, top: Column, width: Column, height: Column, kind: str = "double") -> Column:
    return F.struct(*[c.cast(kind).alias(n) for c, n in zip((left, top, width, height), ("left", "top", "width", "height"), strict=True)])


def aspect_ratio(width: Column, height: Column, given: Column) -> Column:
    """width / height if both are set (and the height is not 0), else the ratio given."""
    return F.coalesce(F.try_divide(width.cast("double"), height.cast("double")), given.cast("double"))


def layer_ratio(crop_width: Column, crop_height: Column, layer_width: Column, layer_height: Column) -> Column:
    """Of the crop if there is one, else of the layer; null where it is not finite."""
    of_crop = F.try_divide(crop_width.cast("double"), crop_height.cast("double"))
    of_layer = F.try_divide(layer_width.cast("double"), layer_height.cast("double"))
    return F.when(crop_width.isNotNull() & crop_height.isNotNull(), of_crop).otherwise(of_layer)


def resolve_size(
    width: Column, height: Column, crop_width: Column, crop_height: Column, layer_width: Column, layer_height: Column,
) -> Column:
    """struct(width, height, error) of the output from the request and its first layer.

    Both sides set: as asked.  One set: the other from the ratio.  None set: the
    crop's size rounded, else the layer's.  ``no_size``: a side is missing and
    there is no layer; ``bad_ratio``: it would not be finite.
    """
    ratio = layer_ratio(crop_width, crop_height, layer_width, layer_height)
    have_w, have_h = width.isNotNull(), height.isNotNull()
    no_layer = layer_width.isNull() | layer_height.isNull()
    free_w = F.coalesce(rounded(crop_width.cast("double")), layer_width.cast("int"))
    free_h = F.coalesce(rounded(crop_height.cast("double")), layer_height.cast("int"))
    w = F.when(have_w, width.cast("int")).when(no_layer, None).when(have_h, rounded(height * ratio)).otherwise(free_w)
    h = F.when(have_h, height.cast("int")).when(no_layer, None).when(have_w, rounded(F.try_divide(width.cast("double"), ratio))).otherwise(free_h)
    error = F.when(~(have_w & have_h) & no_layer, "no_size").when(w.isNull() | h.isNull(), "bad_ratio")
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"), error.alias("error"))


def destination(dst: Column, width: Column, height: Column) -> Column:
    """The given rectangle, else the whole output."""
    return F.coalesce(dst, rect(F.lit(0), F.lit(0), width, height))


def truncated_rect(r: Column) -> Column:
    return rect(*(r[n].try_cast("int") for n in ("left", "top", "width", "height")), kind="int")


def rounded_rect(r: Column) -> Column:
    return rect(*(rounded(r[n]) for n in ("left", "top", "width", "height")), kind="int")


def legacy_size(asked: Column, crop_side: Column, image_side: Column) -> Column:
    """A side on the older path: as asked, else the crop's rounded, else the image's; no ratio."""
    return F.coalesce(asked.cast("int"), rounded(crop_side.cast("double")), image_side.cast("int"))


def conversion_size(resize_width: Column, width: Column, height: Column) -> Column:
    """struct(width, height) of a file conversion to a width: at least 1 each, the height from the ratio."""
    ratio = F.try_divide(width.cast("double"), height.cast("double"))
    w = F.greatest(F.lit(1), resize_width.cast("int"))
    h = F.greatest(F.lit(1), rounded(F.try_divide(resize_width.cast("double"), ratio)))
    free = resize_width.isNull()
    return F.struct(F.when(free, width.cast("int")).otherwise(w).alias("width"), F.when(free, height.cast("int")).otherwise(h).alias("height"))


def auto_crop(width: Column, height: Column, ratio: Column) -> Column:
    """The largest centred rectangle of a ratio; the whole image without one."""
    w, h = width.cast("double"), height.cast("double")
    wide = F.try_divide(w, h) > ratio
    cw = F.when(ratio.isNull(), w).when(wide, h * ratio).otherwise(w)
    ch = F.when(ratio.isNull() | wide, h).otherwise(F.try_divide(w, ratio))
    return rect((w - cw) / 2.0, (h - ch) / 2.0, cw, ch)


def translated(r: Column, dx: Column, dy: Column) -> Column:
    return rect(r["left"] + dx, r["top"] + dy, r["width"], r["height"])


def clipped(r: Column, clip: Column) -> Column:
    """What two rectangles share; width or height 0 if nothing."""
    left, top = F.greatest(r["left"], clip["left"]), F.greatest(r["top"], clip["top"])
    right = F.least(r["left"] + r["width"], clip["left"] + clip["width"])
    bottom = F.least(r["top"] + r["height"], clip["top"] + clip["height"])
    zero = F.lit(0.0)
    return rect(left, top, F.greatest(zero, right - left), F.greatest(zero, bottom - top))


def loaded_side(side: Column, other: Column, fallback: int = 300) -> Column:
    """A loader's side: images that report 0 x 0 count as ``fallback``."""
    return F.when((side == 0) & (other == 0), fallback).otherwise(side)
