"""Compositing, resizing and placeholders: requests in, encoded images out, one row each, in Arrow batches.

A row that fails gives null bytes and an ``error``; the job goes on.  Python
sees pixels only; sizes, labels and targets come from native expressions.  Spark
bounds the batches that reach Python by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``),
and each row's pixels are dropped before the next row is read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import encoding as E
from ..functions import geometry as G
from ..schema import DEFAULT_QUALITY, PLACEHOLDER_SIDE
from ..sources.sinks import skip_existing
from . import codec

_SIZE = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("error", T.StringType())]
RESULT = T.StructType([T.StructField("bytes", T.BinaryType()), *_SIZE])
SIZE = T.StructType(_SIZE)


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt over all cores, before each becomes an image.

    Spark cuts files into tasks by their bytes, so a file of millions of numbers is one task, whatever is made of a row.
    """
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks)


# ---- pixels ----


def with_alpha(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] == 4:
        return pixels
    return np.dstack([pixels, np.full(pixels.shape[:2], 255, np.uint8)])


def draw(canvas: np.ndarray, layer: np.ndarray, src: tuple, dst: tuple, truncate: bool = True) -> None:
    """Lay ``src`` of a layer over ``dst`` of the canvas: nearest samples, source-over alpha, cut to the canvas."""
    if truncate:
        src, dst = tuple(map(math.trunc, src)), tuple(map(math.trunc, dst))
    sx, sy, sw, sh = src
    dx, dy, dw, dh = dst
    if dw <= 0 or dh <= 0 or sw <= 0 or sh <= 0:
        return
    h, w = canvas.shape[:2]
    x0, x1 = max(0, math.floor(dx)), min(w, math.ceil(dx + dw))
    y0, y1 = max(0, math.floor(dy)), min(h, math.ceil(dy + dh))
    if x0 >= x1 or y0 >= y1:
        return
    xs, ys = np.arange(x0, x1), np.arange(y0, y1)
    # Cell centres keep within the rectangle for unrounded ones; for whole numbers this is floor(k * sw / dw).
    from_x = np.floor(sx + np.maximum(0, xs - dx) * sw / dw).astype(int).clip(0, layer.shape[1] - 1)
    from_y = np.floor(sy + np.maximum(0, ys - dy) * sh / dh).astype(int).clip(0, layer.shape[0] - 1)
    above, spot = layer[from_y[:, None], from_x], canvas[y0:y1, x0:x1]
    if above.shape[2] == 3 or (above[:, :, 3] == 255).all():  # nothing shines through
        spot[:, :, :3], spot[:, :, 3] = above[:, :, :3], 255
        return
    above, below = above.astype(np.float64), spot.astype(np.float64)
    a, b = above[:, :, 3:] / 255, below[:, :, 3:] / 255
    out = a + b * (1 - a)
    color = np.where(out > 0, (above[:, :, :3] * a + below[:, :, :3] * b * (1 - a)) / np.where(out > 0, out, 1), 0)
    spot[:] = np.floor(np.dstack([color, out * 255]) + 0.5).astype(np.uint8)


def _half_up(x: float) -> int:
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def output_size(width, height, crop, layer_size) -> tuple[int, int]:
    """The rule of ``geometry.resolve_size`` where the layer's size is known only after decoding."""
    if width is not None and height is not None:
        return width, height
    if layer_size is None:
        raise codec.CodecError("no_size")
    cw, ch = (crop[2], crop[3]) if crop else layer_size
    try:
        ratio = cw / ch
        if width is not None:
            return width, _half_up(width / ratio)
        if height is not None:
            return _half_up(height * ratio), height
    except (ZeroDivisionError, OverflowError) as e:
        raise codec.CodecError("bad_ratio") from e
    return (_half_up(cw), _half_up(ch)) if crop else layer_size


def _rect(r) -> tuple | None:
    return None if r is None else (r["left"], r["top"], r["width"], r["height"])


def compose_one(layers: list, width: int | None, height: int | None, kind: str, quality: int | None, truncate: bool, encoders: dict | None = None) -> tuple[bytes, int, int]:
    """Layers in list order; only the first decides the size.  ``encoders`` are those of further kinds."""
    canvas = None
    if width is not None and height is not None:
        canvas = np.zeros((height, width, 4), np.uint8)
    for layer in layers:
        pixels = codec.decode(bytes(layer["bytes"] or b""))
        src, dst = _rect(layer["src"]), _rect(layer["dst"])
        size = (pixels.shape[1], pixels.shape[0])
        if canvas is None:
            w, h = output_size(width, height, src, size)
            canvas = np.zeros((h, w, 4), np.uint8)
        draw(canvas, pixels, src or (0, 0, *size), dst or (0, 0, canvas.shape[1], canvas.shape[0]), truncate)
    if canvas is None:
        raise codec.CodecError("no_size")
    encode = (encoders or {}).get(kind)
    return encode(canvas, quality) if encode else codec.encode(canvas, kind, quality), canvas.shape[1], canvas.shape[0]


def _int(x) -> int | None:
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else int(x)


def _composer(encoders: dict):
    """The batch function, with the encoders that are registered on the driver."""

    def compose(requests: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in requests.to_dict("records"):
            try:
                if r["problem"]:
                    raise codec.CodecError(r["problem"])
                done = compose_one(list(r["layers"]) if r["layers"] is not None else [], _int(r["width"]), _int(r["height"]), r["kind"], _int(r["quality"]), bool(r["truncate"]), encoders)
                out.append((*done, None))
            except codec.CodecError as e:
                out.append((None, None, None, str(e) or "decode_failed"))
        frame = pd.DataFrame(out, columns=["bytes", "width", "height", "error"])
        return frame.astype({"width": "Int32", "height": "Int32"})

    return compose


def compose_images(requests: DataFrame, *, mode: str = "correct", strict: bool = False) -> DataFrame:
    """``requests`` (layers, width, height, encoding) with ``image``: struct(bytes, encoding, width, height, error).

    ``mode`` names the encode-target rule; ``compose_web`` also keeps rectangles
    unrounded.  ``strict`` raises instead of returning an error.
    """
    target = E.encode_target(F.col("encoding.kind"), F.col("encoding.quality"), F.lit(mode))
    bad_quality = F.when((F.col("encoding.kind") == "jpg") & ~E.quality_ok(F.col("encoding.quality")), "bad_quality")
    ask = F.struct(
        F.col("layers"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"),
        target["bytes_kind"].alias("kind"), target["label_quality"].alias("quality"),
        F.coalesce(target["error"], bad_quality).alias("problem"), F.lit(mode != "compose_web").alias("truncate"))
    made = requests.withColumn("_made", F.pandas_udf(_composer(dict(E.ENCODERS)), RESULT)(ask))
    image = F.struct(
        F.col("_made.bytes").alias("bytes"), E.encoding(target["label_kind"], target["label_quality"]).alias("encoding"),
        F.col("_made.width").alias("width"), F.col("_made.height").alias("height"), F.col("_made.error").alias("error"))
    if strict:
        image = F.when(F.col("_made.error").isNull(), image).otherwise(F.raise_error(F.col("_made.error")))
    return made.withColumn("image", image).drop("_made")


def resize_images(images: DataFrame, *, width: Column, height: Column, crop: Column | None = None, kind: str = "png", quality: int | None = None, mode: str = "correct") -> DataFrame:
    """Images (a ``bytes`` column) resized: a request of one layer each."""
    rect_type = "struct<left: double, top: double, width: double, height: double>"
    none = F.lit(None).cast(rect_type)
    layer = F.struct(F.col("bytes"), (none if crop is None else crop.cast(rect_type)).alias("src"), none.alias("dst"))
    asked = images.select(
        "*", F.array(layer).alias("layers"), width.cast("int").alias("width"), height.cast("int").alias("height"),
        E.encoding(F.lit(kind), F.lit(quality)).alias("encoding"))
    return compose_images(asked, mode=mode).drop("layers", "width", "height", "encoding")


def layers_from_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, layers) of layers that are rows: an array sorted by ``order``, which must be unique within a key."""
    item = F.struct(*order, "bytes", "src", "dst")
    sorted_ = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["bytes"].alias("bytes"), x["src"].alias("src"), x["dst"].alias("dst")))
    return rows.groupBy(key).agg(sorted_.alias("layers"))


def _placeholder_batch(requests: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in requests.to_dict("records"):
        w, h, color = _int(r["width"]), _int(r["height"]), r["color"]
        pixels = np.zeros((h, w, 3), np.uint8)
        if color is not None and color == color:
            c = int(color)
            pixels = np.zeros((h, w, 4), np.uint8)
            pixels[:, :] = (c >> 16 & 255, c >> 8 & 255, c & 255, c >> 24 & 255)
        out.append((codec.encode(pixels, r["kind"], _int(r["quality"])), w, h, None))
    return pd.DataFrame(out, columns=["bytes", "width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})


def placeholders(requests: DataFrame) -> DataFrame:
    """``requests`` (width, height, color, encoding; any of them null) with ``image``.

    256 x 256 and JPG(50) by default; a packed colour fills the image, none leaves it black.  Requests are dealt
    over all cores.
    """
    target = E.encode_target(F.col("encoding.kind"), F.col("encoding.quality"), F.lit("placeholder"))
    side = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(PLACEHOLDER_SIDE)).alias(c)
    ask = F.struct(side("width"), side("height"), F.col("color").cast("long").alias("color"), target["bytes_kind"].alias("kind"), F.coalesce(target["label_quality"], F.lit(DEFAULT_QUALITY)).alias("quality"))
    made = spread(requests).withColumn("_made", F.pandas_udf(_placeholder_batch, RESULT)(ask))
    image = F.struct(F.col("_made.bytes").alias("bytes"), E.encoding(target["label_kind"], target["label_quality"]).alias("encoding"), F.col("_made.width").alias("width"), F.col("_made.height").alias("height"))
    return made.withColumn("image", image).drop("_made")


# ---- metadata ----


def _header_batch(data: pd.Series) -> pd.DataFrame:
    return _sizes(data, codec.header_size)


def _decoded_size(data: bytes) -> tuple[int, int]:
    if codec.sniff(data) == "webp":  # no pixel decoder for it: the header is all there is
        return codec.header_size(data)
    pixels = codec.decode(data)
    return pixels.shape[1], pixels.shape[0]


def _decoded_batch(data: pd.Series) -> pd.DataFrame:
    return _sizes(data, _decoded_size)


def _sizes(data: pd.Series, of) -> pd.DataFrame:
    out = []
    for d in data:
        try:
            out.append((*of(bytes(d or b"")), None))
        except codec.CodecError as e:
            out.append((None, None, str(e) or "decode_failed"))
    return pd.DataFrame(out, columns=["width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})


def png_header_size(data: Column) -> Column:
    """struct(width, height) from a PNG's header, natively."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).try_cast("int")
    ok = E.is_png(data) & (F.length(data) >= 24)
    return F.struct(F.when(ok, number(17)).alias("width"), F.when(ok, number(21)).alias("height"))


def image_meta(images: DataFrame, *, data: str = "bytes", mode: str = "fast") -> DataFrame:
    """``images`` with ``meta``: struct(width, height, encoding, error).

    ``fast`` reads headers, ``strict`` decodes what can be decoded.  Unknown
    bytes are found natively and never reach Python.
    """
    kind = E.sniff_kind(F.col(data))
    size = F.pandas_udf(_header_batch if mode == "fast" else _decoded_batch, SIZE)(F.when(kind.isNotNull(), F.col(data)))
    out = images.withColumn("_size", size)
    error = F.when(kind.isNull(), "unsupported_type").otherwise(F.col("_size.error"))
    meta = F.struct(F.col("_size.width").alias("width"), F.col("_size.height").alias("height"), E.sniff_encoding(F.col(data)).alias("encoding"), error.alias("error"))
    return out.withColumn("meta", meta).drop("_size")


def convert_files(
    images: DataFrame, *, kind: str = "png", crop: Column | None = None, resize_width: Column | None = None,
    existing: DataFrame | None = None, dst: str = "dst", force: bool = False,
) -> DataFrame:
    """The file conversion path: crop in whole pixels, pad where the crop leaves the image, average down to a width, encode.

    With ``existing`` (a column ``dst`` of names), rows whose ``dst`` is among them are left out before
    anything is decoded, unless ``force``.  WebP needs an encoder that is not installed here: its rows carry
    ``unsupported_target`` unless one is registered.
    """
    if existing is not None:
        images = skip_existing(images, existing, dst=dst, force=force)
    none_rect = F.lit(None).cast("struct<left: int, top: int, width: int, height: int>")
    ask = F.struct(F.col("bytes"), (none_rect if crop is None else crop).alias("crop"), (F.lit(None).cast("int") if resize_width is None else resize_width.cast("int")).alias("to"), F.lit(kind).alias("kind"))
    encoders = dict(E.ENCODERS)

    def convert(requests: pd.DataFrame) -> pd.DataFrame:
        return _convert_batch(requests, encoders)

    return images.withColumn("image", F.pandas_udf(convert, RESULT)(ask))


def _convert_batch(requests: pd.DataFrame, encoders: dict) -> pd.DataFrame:
    out = []
    for r in requests.to_dict("records"):
        try:
            encode = encoders.get(r["kind"])
            if encode is None and r["kind"] not in ("png", "jpg"):
                raise codec.CodecError("unsupported_target")
            pixels = with_alpha(codec.decode(bytes(r["bytes"] or b"")))
            if r["crop"] is not None:
                x, y, w, h = (int(r["crop"][k]) for k in ("left", "top", "width", "height"))
                if w <= 0 or h <= 0:
                    raise codec.CodecError("no_size")
                part = pixels[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
                if part.shape[:2] != (h, w):
                    whole = np.zeros((h, w, 4), np.uint8)
                    dy, dx = (h - part.shape[0]) // 2, (w - part.shape[1]) // 2
                    whole[dy : dy + part.shape[0], dx : dx + part.shape[1]] = part
                    part = whole
                pixels = part
            to = _int(r["to"])
            if to is not None:
                ratio = pixels.shape[1] / pixels.shape[0]
                pixels = average(pixels, max(1, to), max(1, _half_up(to / ratio)))
            out.append((encode(pixels, None) if encode else codec.encode(pixels, r["kind"]), pixels.shape[1], pixels.shape[0], None))
        except codec.CodecError as e:
            out.append((None, None, None, str(e) or "decode_failed"))
    return pd.DataFrame(out, columns=["bytes", "width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})


def average(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The mean over each output pixel's cell of the input."""
    h, w = pixels.shape[:2]
    sums = np.zeros((h + 1, w + 1, pixels.shape[2]))
    sums[1:, 1:] = pixels.astype(np.float64).cumsum(0).cumsum(1)
    x0, y0 = np.arange(width) * w // width, np.arange(height) * h // height
    x1, y1 = np.maximum(x0 + 1, (np.arange(width) + 1) * w // width), np.maximum(y0 + 1, (np.arange(height) + 1) * h // height)
    total = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    n = (y1 - y0)[:, None, None] * (x1 - x0)[None, :, None]
    return np.floor(total / n + 0.5).astype(np.uint8)


def _gray_png_batch(px: pd.Series) -> pd.Series:
    out = []
    for v in px:
        side = math.isqrt(len(v))
        out.append(codec.encode_png(np.repeat(np.asarray(v, np.uint8).reshape(side, side, 1), 3, axis=2)))
    return pd.Series(out)


def _first_channel_batch(data: pd.Series) -> pd.Series:
    return data.map(lambda v: codec.decode(bytes(v))[:, :, 0].ravel().tolist())


def gray_png(px: Column) -> Column:
    """A square picture, PNG, from an array of byte values."""
    return F.pandas_udf(_gray_png_batch, T.BinaryType())(px)


def _gray_jpg_batch(value: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([codec.encode_jpg(np.full((h, w, 3), v, np.uint8), 95) for v, w, h in zip(value, width, height, strict=True)])


def flat_jpg(value: Column, width: Column, height: Column) -> Column:
    """A JPG of one gray value."""
    return F.pandas_udf(_gray_jpg_batch, T.BinaryType())(value.cast("int"), width.cast("int"), height.cast("int"))


def first_channel(data: Column) -> Column:
    """The values of an image's first channel, row by row."""
    return F.pandas_udf(_first_channel_batch, T.ArrayType(T.IntegerType()))(data)
