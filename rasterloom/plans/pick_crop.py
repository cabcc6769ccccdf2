"""The whole flow: pick, crop, resize, encode.

A human's crop is a row of an annotation table; a picture without one was
cancelled and gives a null image, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import encoding
from ..functions.geometry import aspect_ratio, auto_crop
from ..operators.compose import compose_images, image_meta
from ..sources.files import narrow_join


def pick_crop(
    images: DataFrame, crops: DataFrame, *, width: int | None = None, height: int | None = None, aspect: float | None = None,
    kind: str = "png", quality: int | None = None, auto: bool = False, oval_mask: bool = False, convert: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(image_id, rect, image) for each of ``images`` (image_id, bytes).

    ``auto``: the largest centred rectangle of the aspect ratio (both sides set
    win over ``aspect``); else the rectangle of ``crops`` (image_id, rect).  The
    aspect steers cropping only.  ``oval_mask`` concerns the editor's view and
    never the pixels.  ``convert`` replaces the conversion: a function (such as a
    pandas UDF) of struct(bytes, rect, width, height, encoding) to an image struct.
    """
    del oval_mask
    number = lambda v, kind_: F.lit(v).cast(kind_)
    if auto:
        sized = image_meta(images)
        ratio = aspect_ratio(number(width, "int"), number(height, "int"), number(aspect, "double"))
        rows = sized.withColumn("rect", F.when(F.col("meta.error").isNull(), auto_crop(F.col("meta.width"), F.col("meta.height"), ratio))).drop("meta")
    else:
        mine = crops.select(F.col("image_id").alias("_crop_id"), F.col("rect"))
        rows = narrow_join(images, mine, "image_id", F.col("_crop_id"), "left").drop("_crop_id")
    goes = F.col("rect").isNotNull() & F.col("bytes").isNotNull()
    asked = encoding(F.lit(kind), F.lit(quality))
    if convert is not None:
        request = F.struct("bytes", "rect", number(width, "int").alias("width"), number(height, "int").alias("height"), asked.alias("encoding"))
        return rows.withColumn("image", F.when(goes, convert(request))).select("image_id", "rect", "image")
    rect_type = "struct<left: double, top: double, width: double, height: double>"
    layer = F.struct("bytes", F.col("rect").cast(rect_type).alias("src"), F.lit(None).cast(rect_type).alias("dst"))
    layers = F.when(goes, F.array(layer)).otherwise(F.array().cast(f"array<struct<bytes: binary, src: {rect_type}, dst: {rect_type}>>"))
    request = rows.select("image_id", "rect", goes.alias("_goes"), layers.alias("layers"), number(width, "int").alias("width"), number(height, "int").alias("height"), asked.alias("encoding"))
    made = compose_images(request)
    failed = F.col("image.error").isNotNull()
    return made.select("image_id", "rect", F.when(F.col("_goes") & ~failed, F.col("image")).alias("image"))
