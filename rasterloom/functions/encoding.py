"""Encodings: recognition from magic bytes, names, labels, checks and encode targets, as native expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_QUALITY, UNKNOWN_QUALITY


@dataclass(frozen=True)
class Kind:
    mime: str
    extension: str
    label: str


#: Known kinds; ``register`` adds to them.
KINDS: dict[str, Kind] = {
    "jpg": Kind("image/jpeg", ".jpg", "Jpg"),
    "png": Kind("image/png", ".png", "Png"),
    "webp": Kind("image/webp", ".webp", "Webp"),
}


#: Encoders of further kinds: pixels and quality to bytes.
ENCODERS: dict[str, Callable] = {}


def register(kind: str, mime: str, extension: str, label: str | None = None, encoder: Callable | None = None) -> None:
    """Make a further kind known to the naming functions and, with an ``encoder(pixels, quality) -> bytes``, a target of its own.

    Plans carry the encoders that are registered when they are built.
    """
    KINDS[kind] = Kind(mime, extension, label or kind.capitalize())
    if encoder is not None:
        ENCODERS[kind] = encoder


def starts_with(data: Column, prefix: str) -> Column:
    """Whether binary ``data`` begins with the bytes of the hexadecimal ``prefix``."""
    return F.startswith(data, F.expr(f"X'{prefix}'"))


def is_jpg(data: Column) -> Column:
    return starts_with(data, "FFD8FF")


def is_png(data: Column) -> Column:
    return starts_with(data, "89504E")


def is_webp(data: Column) -> Column:
    return starts_with(data, "52494646") & (F.length(data) >= 12) & (F.substring(data, 9, 4) == F.expr("X'57454250'"))


def sniff_kind(data: Column, strict: bool = False) -> Column:
    """'jpg', 'png' or 'webp', tried in this order; null, or an error if ``strict``, for anything else."""
    other = F.raise_error(F.lit("unsupported_type")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(is_jpg(data), "jpg").when(is_png(data), "png").when(is_webp(data), "webp").otherwise(other)


def sniff_encoding(data: Column, strict: bool = False) -> Column:
    """The encoding struct; a recognised JPG has unknown quality (-1)."""
    kind = sniff_kind(data, strict)
    return encoding(kind, F.when(kind == "jpg", UNKNOWN_QUALITY))


def encoding(kind: Column, quality: Column) -> Column:
    return F.struct(kind.alias("kind"), quality.cast("int").alias("quality"))


def _by_kind(kind: Column, of) -> Column:
    out = F.lit(None).cast("string")
    for name, known in reversed(KINDS.items()):
        out = F.when(kind == name, of(known)).otherwise(out)
    return out


def mime_type(kind: Column) -> Column:
    return _by_kind(kind, lambda k: k.mime)


def extension(kind: Column) -> Column:
    return _by_kind(kind, lambda k: k.extension)


def label(kind: Column, quality: Column) -> Column:
    """Jpg(75), Jpg for an unknown quality, Png, Webp."""
    name = _by_kind(kind, lambda k: k.label)
    known = (kind == "jpg") & (quality != UNKNOWN_QUALITY)
    return F.when(known, F.concat(name, F.lit("("), quality.cast("string"), F.lit(")"))).otherwise(name)


def quality_ok(quality: Column) -> Column:
    """-1 (unknown) to 100."""
    return quality.between(UNKNOWN_QUALITY, 100)


def checked_quality(quality: Column) -> Column:
    """The quality itself, or an error where it is out of range."""
    return F.when(quality_ok(quality), quality).otherwise(F.raise_error(F.lit("bad_quality")).cast("int"))


MODES = ("correct", "placeholder", "compose", "compose_web", "legacy")


def encode_target(kind: Column, quality: Column, mode: Column) -> Column:
    """What an encoder makes of a requested encoding: struct(bytes_kind, label_kind, label_quality, error).

    Modes differ where the request is null or neither JPG nor PNG: ``placeholder``
    encodes and labels it as JPG of default quality; ``compose`` and ``legacy``
    encode PNG under the label asked for; ``compose_web`` refuses; ``correct``
    encodes PNG and says so.  A kind with a registered encoder is a target in all of them.
    """
    own = kind.isin(*ENCODERS) if ENCODERS else F.lit(False)
    quality = F.when(quality == UNKNOWN_QUALITY, DEFAULT_QUALITY).otherwise(quality)
    jpg, png = kind == "jpg", kind == "png"
    other = kind.isNull() | ~(jpg | png | own)
    bad = (mode == "compose_web") & other
    as_jpg = jpg | ((mode == "placeholder") & other)
    bytes_kind = F.when(bad, None).when(as_jpg, "jpg").when(own, kind).otherwise("png")
    label_kind = F.when(bad, None).when(as_jpg, "jpg").when(own, kind).when(png | (mode == "correct") | kind.isNull(), "png").otherwise(kind)
    label_quality = F.when(bad, None).when(jpg, F.coalesce(quality, F.lit(DEFAULT_QUALITY))).when(as_jpg, DEFAULT_QUALITY)
    return F.struct(
        bytes_kind.alias("bytes_kind"), label_kind.alias("label_kind"), label_quality.cast("int").alias("label_quality"),
        F.when(bad, "unsupported_target").alias("error"))


def blob_quality(quality: Column) -> Column:
    """Quality as encoders of canvases take it, 0 to 1."""
    return quality.cast("double") / 100.0


def debug_text(width: Column, height: Column, label_: Column, data: Column | None = None) -> Column:
    """{width: 1, height: 2, encoding: Png, sizeInBytes: 3}."""
    parts = [F.lit("{width: "), width.cast("string"), F.lit(", height: "), height.cast("string"), F.lit(", encoding: "), label_]
    if data is not None:
        parts += [F.lit(", sizeInBytes: "), F.octet_length(data).cast("string")]
    return F.concat(*parts, F.lit("}"))


def options_text(**options: Column) -> Column:
    """{name: value, ...} of the options that are not null."""
    shown = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in options.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *shown), F.lit("}"))
