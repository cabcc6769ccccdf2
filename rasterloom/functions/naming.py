"""Names, texts, data URLs, source literals, encoder arguments and source routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Encoder presets: quality, alpha quality, lossless.
PRESETS = {"default": (50, 100, False), "q50": (50, 100, False), "q75": (75, 100, False), "lossless": (50, 100, True)}
CAMERAS = ("rear", "front")


def data_url(data: Column, mime: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(data), "\r\n", ""))


def hex_literal(data: Column) -> Column:
    """0xff,0x0,...: lower case, without leading zeros."""
    digits = F.lower(F.hex(data))
    byte = lambda i: F.concat(F.lit("0x"), F.regexp_replace(F.substring(digits, 2 * i + 1, F.lit(2)), "^0", ""))
    return F.when(F.octet_length(data) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.octet_length(data) - 1), byte), ","))


def literal_name(name: Column) -> Column:
    return F.replace(name, F.lit("."), F.lit("_"))


def basename(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def temp_png(folder: Column, path: Column, unique: Column | None = None) -> Column:
    """Where a conversion keeps its PNG; ``unique`` keeps equal names of one folder apart."""
    name = basename(path) if unique is None else F.concat(basename(path), F.lit("_"), unique.cast("string"))
    return F.concat(folder, F.lit("/"), name, F.lit(".png"))


def image_name(width: Column, height: Column, ext: Column) -> Column:
    return F.concat(F.lit("image_"), width.cast("string"), F.lit("x"), height.cast("string"), ext)


def encoder_arguments(lossless: Column, quality: Column, alpha_quality: Column, src: Column, dst: Column) -> Column:
    """Arguments of an external encoder; lossless ignores both qualities."""
    lossy = F.concat(F.lit("-q "), quality.cast("string"), F.lit(" -alpha_q "), alpha_quality.cast("string"))
    return F.concat(F.when(lossless, "-lossless").otherwise(lossy), F.lit(" "), src, F.lit(" -o "), dst)


def preset_arguments(preset: Column, src: Column, dst: Column) -> Column:
    """Arguments of an external encoder by the name of a preset; null for an unknown one."""
    known = [(preset == name, encoder_arguments(F.lit(lossless), F.lit(q), F.lit(a), src, dst)) for name, (q, a, lossless) in PRESETS.items()]
    out = F.when(*known[0])
    for condition, value in known[1:]:
        out = out.when(condition, value)
    return out


def source_text(kind: Column, camera: Column, path: Column) -> Column:
    part = lambda name, inner: F.concat(F.lit(f"ImageSource{name}("), inner, F.lit(")"))
    none = F.lit("")
    return (
        F.when(kind == "gallery", part("Gallery", none))
        .when((kind == "camera") & (camera.isNull() | camera.isin(*CAMERAS)), part("Camera", F.coalesce(camera, F.lit(CAMERAS[0]))))
        .when(kind == "memory", part("Memory", none)).when(kind == "asset", part("Asset", F.coalesce(path, none))))


def pick_route(kind: Column, platform: Column, *, strict: bool = False) -> Column:
    """How a source is read: by a picker for gallery and camera, directly for memory and asset.

    Desktops open a file dialog whatever the source; a platform without pickers is an error,
    as a text or, if ``strict``, raised.
    """
    picks = kind.isin("gallery", "camera")
    fail = lambda text: F.raise_error(F.lit(text)).cast("string") if strict else F.lit(text)
    return (
        F.when(kind.isNull() | ~kind.isin("gallery", "camera", "memory", "asset"), fail("unsupported_source")).when(~picks, "direct")
        .when(platform.isin("linux", "windows", "macos"), "file_dialog").when(platform.isin("android", "ios", "web"), F.concat(F.lit("picker_"), kind))
        .otherwise(fail("unsupported_platform")))


def parsed_side(text: Column) -> Column:
    """A side typed as text; null clears it."""
    return F.trim(text).try_cast("int")


def result_text(width: Column, height: Column, n_bytes: Column, mime: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(", "), n_bytes.cast("string"), F.lit(" bytes, "), mime)


def request_text(width: Column, height: Column, oval: Column) -> Column:
    """A summary of a request; ``oval`` shows only beside a size."""
    size = F.when(width.isNotNull() | height.isNotNull(), F.concat(F.coalesce(width.cast("string"), F.lit("")), F.lit("x"), F.coalesce(height.cast("string"), F.lit(""))))
    return F.when(size.isNull(), "").otherwise(F.concat(size, F.when(oval, " oval").otherwise("")))
