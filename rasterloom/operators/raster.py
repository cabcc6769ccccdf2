"""Pixel algebra on decoded rasters as array expressions: one array of numbers, row by row, ``channels`` a pixel.

For pictures held in columns of numbers (tiles, features, thumbnails).  Whole
photographs go through ``compose``, which works on bytes in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("int")


def _cells(n: Column, value) -> Column:
    """``value(i)`` for i in 0 .. n - 1."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.array())


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("int")


def blank(width: Column | int, height: Column | int, channels: int = 4) -> Column:
    """A transparent (or black) canvas."""
    return F.array_repeat(F.lit(0), _int(width) * _int(height) * channels)


def fill(width: Column | int, height: Column | int, pixel: Column) -> Column:
    """A canvas of one pixel value (an array of its channels)."""
    return F.flatten(F.array_repeat(pixel, _int(width) * _int(height)))


def _remap(px: Column, width: Column, height: Column, out_w: Column, out_h: Column, channels: int, source, default) -> Column:
    """Cell (x, y) of the output from cell ``source(x, y)`` of the input; ``default`` outside it."""

    def cell(i: Column) -> Column:
        c, p = i % channels, _div(i, F.lit(channels))
        x, y = source(p % out_w, _div(p, out_w))
        inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        return F.when(inside, F.get(px, (y * width + x) * channels + c)).otherwise(default)

    return _cells(out_w * out_h * channels, cell)


def crop(px: Column, width, height, left, top, crop_w, crop_h, channels: int = 1) -> Column:
    """A rectangle, cut to the image: its part outside is not returned."""
    w, h, x0, y0 = _int(width), _int(height), _int(left), _int(top)
    x1, y1 = F.greatest(F.lit(0), x0), F.greatest(F.lit(0), y0)
    cw = F.least(w, x0 + _int(crop_w)) - x1
    ch = F.least(h, y0 + _int(crop_h)) - y1
    return _remap(px, w, h, F.greatest(F.lit(0), cw), F.greatest(F.lit(0), ch), channels, lambda x, y: (x + x1, y + y1), F.lit(None))


def pad(px: Column, width, height, out_w, out_h, channels: int = 1) -> Column:
    """The image in the middle of a larger canvas of zeros."""
    w, h, ow, oh = (_int(v) for v in (width, height, out_w, out_h))
    dx, dy = _div(ow - w, F.lit(2)), _div(oh - h, F.lit(2))
    return _remap(px, w, h, ow, oh, channels, lambda x, y: (x - dx, y - dy), F.lit(0))


def resize_nearest(px: Column, width, height, out_w, out_h, channels: int = 1) -> Column:
    """Pixel (x, y) from (floor(x * w / out_w), floor(y * h / out_h))."""
    w, h, ow, oh = (_int(v) for v in (width, height, out_w, out_h))
    return _remap(px, w, h, ow, oh, channels, lambda x, y: (_div(x * w, ow), _div(y * h, oh)), F.lit(None))


def resize_average(px: Column, width, height, out_w, out_h, channels: int = 1) -> Column:
    """The mean over each output pixel's cell of the input (one pixel at least), in doubles."""
    w, h, ow, oh = (_int(v) for v in (width, height, out_w, out_h))

    def cell(i: Column) -> Column:
        c, p = i % channels, _div(i, F.lit(channels))
        x, y = p % ow, _div(p, ow)
        x0, y0 = _div(x * w, ow), _div(y * h, oh)
        x1 = F.greatest(x0 + 1, _div((x + 1) * w, ow))
        y1 = F.greatest(y0 + 1, _div((y + 1) * h, oh))
        n = (x1 - x0) * (y1 - y0)
        at = lambda k: F.get(px, ((y0 + _div(k, x1 - x0)) * w + x0 + k % (x1 - x0)) * channels + c)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, k: acc + at(k).cast("double")) / n

    return _cells(ow * oh * channels, cell)


def rotate_quarters(px: Column, width, height, quarters: int, channels: int = 1) -> Column:
    """Turned clockwise by a multiple of 90 degrees."""
    w, h, k = _int(width), _int(height), quarters % 4
    source = {
        0: lambda x, y: (x, y), 1: lambda x, y: (y, h - 1 - x), 2: lambda x, y: (w - 1 - x, h - 1 - y), 3: lambda x, y: (w - 1 - y, x)}[k]
    return _remap(px, w, h, h if k % 2 else w, w if k % 2 else h, channels, source, F.lit(None))


def source_over(below: Column, above: Column, alpha: Column) -> Column:
    """One value over another."""
    return above * alpha + below * (1.0 - alpha)


def blend(below: Column, above: Column, alpha: Column) -> Column:
    """Arrays of one size, value by value, with one alpha for all."""
    return F.zip_with(below, above, lambda b, a: source_over(b, a, alpha))


def fold_layers(layers: Column, start: Column, value, alpha) -> Column:
    """Layers (an array of structs that sorts by its first fields) over ``start``, in order: the order decides the result."""
    return F.aggregate(F.array_sort(layers), start, lambda acc, x: source_over(acc, value(x), alpha(x)))
