"""Encodings, geometry, codecs, composing, sources, sinks and the whole flow."""

import os
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions import encoding as E
from rasterloom.functions import geometry as G
from rasterloom.functions import naming as N
from rasterloom.operators import codec
from rasterloom.operators import compose as P
from rasterloom.plans.pick_crop import pick_crop
from rasterloom.sources import files, sinks
from rasterloom.streaming.landing import describe, describe_arrivals


def picture(h=5, w=7, channels=4, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, channels), dtype=np.uint8)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("data,kind", [
    (b"\xff\xd8\xff\xe0", "jpg"), (b"\x89PNG", "png"), (b"\x89PN", "png"), (b"RIFF\0\0\0\0WEBP", "webp"), (b"RIFF\0\0\0\0WAVE", None), (b"RIFFWEBP", None),
    (b"", None), (b"\xff\xd8", None), (b"BM", None)])
def test_sniff(spark, data, kind):
    row = one(spark, E.sniff_encoding(F.lit(bytearray(data))).alias("e"))
    assert row.e.kind == kind and row.e.quality == (-1 if kind == "jpg" else None)
    assert codec.sniff(data) == kind


def test_strict_sniff_raises(spark):
    with pytest.raises(Exception, match="unsupported_type"):
        one(spark, E.sniff_kind(F.lit(bytearray(b"BM")), strict=True))


def test_labels_and_quality(spark):
    lit = F.lit
    row = one(spark, E.label(lit("jpg"), lit(75)), E.label(lit("jpg"), lit(-1)), E.label(lit("png"), lit(None)), E.mime_type(lit("jpg")), E.extension(lit("webp")))
    assert tuple(row) == ("Jpg(75)", "Jpg", "Png", "image/jpeg", ".webp")
    assert tuple(one(spark, *[E.quality_ok(lit(q)) for q in (-2, -1, 0, 100, 101)])) == (False, True, True, True, False)
    with pytest.raises(Exception, match="bad_quality"):
        one(spark, E.checked_quality(lit(101)))


def test_registered_kind(spark):
    E.register("gif", "image/gif", ".gif")
    try:
        assert tuple(one(spark, E.mime_type(F.lit("gif")), E.extension(F.lit("gif")))) == ("image/gif", ".gif")
    finally:
        del E.KINDS["gif"]


@pytest.mark.parametrize("asked,want", [
    ((48, None, None, None, 1, 1), (48, 48, None)), ((None, 48, None, None, 1, 1), (48, 48, None)), ((None, None, None, None, 1, 1), (1, 1, None)),
    ((500, None, 0.5, 0.2, 1, 1), (500, 200, None)), ((None, None, 0.5, 0.5, 9, 9), (1, 1, None)), ((4, 3, None, None, None, None), (4, 3, None)),
    ((4, None, None, None, None, None), (4, None, "no_size")), ((4, None, 1.0, 0.0, 9, 9), (4, None, "bad_ratio")), ((None, 3, 5.0, 2.0, 9, 9), (8, 3, None))])
def test_size_resolution(spark, asked, want):
    kinds = ("int", "int", "double", "double", "int", "int")
    row = one(spark, G.resolve_size(*[F.lit(v).cast(k) for v, k in zip(asked, kinds)]).alias("s"))
    assert tuple(row.s) == want


def test_roundings_differ(spark):
    r = G.rect(*map(F.lit, (-2.5, 2.5, 0.5, 1.9)))
    row = one(spark, G.truncated_rect(r), G.rounded_rect(r))
    assert tuple(row[0]) == (-2, 2, 0, 1) and tuple(row[1]) == (-3, 3, 1, 2)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.sampled_from([1, 2, 3, 4]), st.integers(0, 99))
def test_png_round_trip(h, w, channels, seed):
    px = picture(h, w, channels, seed)
    back = codec.decode_png(codec.encode_png(px))
    want = px if channels > 2 else np.dstack([px[:, :, 0]] * 3 + ([px[:, :, 1]] if channels == 2 else []))
    assert (back == want).all()
    assert codec.header_size(codec.encode_png(px)) == (w, h)


def filtered_png(px, kinds, interlace=0):
    """A PNG whose rows use the given filters, written the slow way."""
    h, w, c = px.shape
    raw, above = b"", np.zeros(w * c, int)
    for y in range(h):
        line, kind = px[y].reshape(-1).astype(int), kinds[y % len(kinds)]
        left = np.concatenate([np.zeros(c, int), line[:-c]])
        corner = np.concatenate([np.zeros(c, int), above[:-c]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * line, left, above, (left + above) // 2, paeth][kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    head = struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[c], 0, 0, interlace)
    return codec.PNG_SIGNATURE + codec._chunk(b"IHDR", head) + codec._chunk(b"IDAT", zlib.compress(raw)) + codec._chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [3, 4])
def test_png_filters(channels):
    px = picture(10, 6, channels, 3)
    assert (codec.decode_png(filtered_png(px, [0, 1, 2, 3, 4])) == px).all()


def test_palette_and_low_depth():
    head = struct.pack(">IIBBBBB", 3, 1, 2, 3, 0, 0, 0)
    data = codec.PNG_SIGNATURE + codec._chunk(b"IHDR", head) + codec._chunk(b"PLTE", bytes(range(9))) + codec._chunk(b"tRNS", b"\x07")
    data += codec._chunk(b"IDAT", zlib.compress(b"\0\x24")) + codec._chunk(b"IEND", b"")
    assert codec.decode_png(data).tolist() == [[[0, 1, 2, 7], [6, 7, 8, 255], [3, 4, 5, 255]]]


@pytest.mark.parametrize("data", [b"", b"\x89PNG", codec.PNG_SIGNATURE, codec.encode_png(picture())[:-30], b"\xff\xd8\xff", b"RIFF\0\0\0\0WEBPVP8 "])
def test_broken_bytes_are_errors(data):
    with pytest.raises((codec.CodecError, ValueError)):
        codec.decode(data)
    if not data.startswith(codec.PNG_SIGNATURE[:8] + b"\0\0\0\rIHDR"):
        with pytest.raises((codec.CodecError, ValueError)):
            codec.header_size(data)


def test_webp_headers():
    riff = lambda body: b"RIFF\0\0\0\0WEBP" + body
    assert codec.header_size(riff(b"VP8X" + bytes(8) + (639).to_bytes(3, "little") + (479).to_bytes(3, "little"))) == (640, 480)
    assert codec.header_size(riff(b"VP8L" + bytes(4) + b"\x2f" + (99 | 49 << 14).to_bytes(4, "little"))) == (100, 50)
    assert codec.header_size(riff(b"VP8 " + bytes(7) + b"\x9d\x01\x2a" + struct.pack("<HH", 33, 44))) == (33, 44)


def test_files_written_here_are_read_by_the_image_source(spark, tmp_path):
    y, x = np.mgrid[0:21, 0:34]
    smooth = np.dstack([x * 7, y * 11, (x + y) * 4]).astype(np.uint8)
    images = [("a/p.png", codec.encode_png(smooth)), ("a/q.jpg", codec.encode_jpg(smooth, 90)), ("broken.png", b"\x89PNG nothing")]
    sinks.save_images(spark.createDataFrame([(n, bytearray(b)) for n, b in images], "name string, bytes binary"), str(tmp_path))
    rows = {os.path.basename(r.path): r for r in files.decoded_files(spark, f"{tmp_path}/*").union(files.decoded_files(spark, f"{tmp_path}/*.png")).distinct().collect()}
    assert rows["broken.png"].error == "decode_failed"
    for name, far in (("p.png", 0), ("q.jpg", 12)):
        r = rows[name]
        assert (r.width, r.height, r.error) == (34, 21, None)
        got = np.frombuffer(bytes(r.image.data), np.uint8).reshape(21, 34, 3)[:, :, ::-1].astype(int)
        assert abs(got - smooth).max() <= far
    listed = files.image_files(spark, str(tmp_path), glob="*.jpg")
    assert [r.kind for r in describe(listed).collect()] == ["jpg"]
    assert "bytes" not in listed.select("path", "length")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    with pytest.raises(Exception, match="outside"):
        sinks.save_images(spark.createDataFrame([("../x", bytearray(b"1"))], "name string, bytes binary"), str(tmp_path / "a"))


@pytest.mark.parametrize("quality", [0, 1, 50, 100])
def test_jpg_header_and_random_pixels(quality):
    data = codec.encode_jpg(picture(9, 17, 3), quality)
    assert codec.sniff(data) == "jpg" and codec.header_size(data) == (17, 9)
    assert codec.sniff(codec.encode_jpg(np.zeros((1, 1, 3), np.uint8), quality)) == "jpg"


def images_df(spark, n=3):
    return spark.createDataFrame([(i, bytearray(codec.encode_png(picture(4 + i, 6, 4, i)))) for i in range(n)], "image_id long, bytes binary")


def test_meta_fast_and_strict(spark):
    rows = images_df(spark).union(spark.createDataFrame([(8, bytearray(b"BM")), (9, bytearray(b"\x89PNG")), (10, None)], "image_id long, bytes binary"))
    for mode in ("fast", "strict"):
        got = {r.image_id: r.meta for r in P.image_meta(rows, mode=mode).collect()}
        assert (got[1].width, got[1].height, got[1].encoding.kind, got[1].error) == (6, 5, "png", None)
        assert got[8].error == got[10].error == "unsupported_type" and got[9].error and got[9].width is None


def test_crop_and_paste_back_is_identity(spark):
    px = picture(6, 8, 4, 1)
    px[:, :, 3] = 255
    out = P.resize_images(spark.createDataFrame([(1, bytearray(codec.encode_png(px)))], "image_id long, bytes binary"), width=F.lit(None), height=F.lit(None), crop=G.rect(*map(F.lit, (2.0, 1.0, 5.0, 4.0)))).first()
    assert (codec.decode_png(bytes(out.image.bytes)) == px[1:5, 2:7]).all()
    assert out.image.encoding.kind == "png" and out.image.error is None


def test_targets_by_mode(spark):
    image = images_df(spark, 1)
    label = lambda mode: P.resize_images(image, width=F.lit(3), height=F.lit(3), kind="webp", mode=mode).first().image
    assert label("correct").encoding.kind == "png" and label("compose").encoding.kind == "webp"
    assert codec.sniff(bytes(label("compose").bytes)) == "png"
    assert label("compose_web").error == "unsupported_target" and label("compose_web").bytes is None
    assert P.resize_images(image, width=F.lit(3), height=F.lit(3), kind="jpg", quality=101).first().image.error == "bad_quality"


def test_composing_errors_and_blank(spark):
    schema = "image_id long, layers array<struct<bytes: binary, src: struct<left: double, top: double, width: double, height: double>, dst: struct<left: double, top: double, width: double, height: double>>>, width int, height int, encoding struct<kind: string, quality: int>"
    png = ("png", None)
    rows = [(1, [], 4, 3, png), (2, [], 4, None, png), (3, None, None, None, png), (4, [(bytearray(b"BM"), None, None)], 4, 3, png)]
    got = {r.image_id: r.image for r in P.compose_images(spark.createDataFrame(rows, schema)).collect()}
    assert (codec.decode_png(bytes(got[1].bytes)) == 0).all() and (got[1].width, got[1].height) == (4, 3)
    assert got[2].error == got[3].error == "no_size" and got[4].error == "decode_failed"
    with pytest.raises(Exception, match="no_size"):
        P.compose_images(spark.createDataFrame(rows[1:2], schema), strict=True).collect()


def test_later_layers_do_not_change_the_size_and_order_decides(spark):
    def solid(h, w, rgba):
        return bytearray(codec.encode_png(np.full((h, w, 4), rgba, np.uint8)))

    rect = "struct<left: double, top: double, width: double, height: double>"
    rows = [(1, z, b, None, None) for z, b in ((2, solid(9, 9, (0, 255, 0, 255))), (1, solid(3, 2, (255, 0, 0, 255))))]
    rows += [(2, z, b, None, None) for z, b in ((1, solid(3, 2, (255, 0, 0, 255))), (2, solid(1, 1, (0, 0, 255, 128))))]
    df = spark.createDataFrame(rows, f"image_id long, z int, bytes binary, src {rect}, dst {rect}")
    asked = P.layers_from_rows(df, "image_id", ["z"]).select("*", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), E.encoding(F.lit("png"), F.lit(None)).alias("encoding"))
    got = {r.image_id: r.image for r in P.compose_images(asked).collect()}
    assert (got[1].width, got[1].height) == (2, 3)
    assert codec.decode_png(bytes(got[1].bytes))[0, 0].tolist() == [0, 255, 0, 255]
    assert codec.decode_png(bytes(got[2].bytes))[0, 0].tolist() == [127, 0, 128, 255]


def test_conversion_crops_pads_and_averages(spark):
    px = picture(4, 4, 4, 2)
    df = spark.createDataFrame([(1, bytearray(codec.encode_png(px)))], "image_id long, bytes binary")
    crop = F.struct(*[F.lit(v).alias(n) for n, v in (("left", 2), ("top", 2), ("width", 4), ("height", 4))])
    out = P.convert_files(df, crop=crop).first().image
    got = codec.decode_png(bytes(out.bytes))
    assert got.shape == (4, 4, 4) and (got[1:3, 1:3] == px[2:, 2:]).all() and got[0].sum() == 0
    small = P.convert_files(df, resize_width=F.lit(2)).first().image
    want = np.floor(px.astype(float).reshape(2, 2, 2, 2, 4).mean(axis=(1, 3)) + 0.5)
    assert (codec.decode_png(bytes(small.bytes)) == want).all()
    assert P.convert_files(df, kind="webp").first().image.error == "unsupported_target"
    assert P.convert_files(df, resize_width=F.lit(0)).first().image.width == 1


def test_pick_crop(spark):
    images = images_df(spark).union(spark.createDataFrame([(7, bytearray(b"BM"))], "image_id long, bytes binary"))
    crops = spark.createDataFrame([(0, (0.0, 0.0, 2.0, 2.0)), (7, (0.0, 0.0, 1.0, 1.0))], "image_id long, rect struct<left: double, top: double, width: double, height: double>")
    got = {r.image_id: r.image for r in pick_crop(images, crops, width=10, oval_mask=True).collect()}
    assert (got[0].width, got[0].height) == (10, 10) and got[1] is None and got[7] is None
    auto = {r.image_id: r for r in pick_crop(images, crops, auto=True, aspect=1.0).collect()}
    assert tuple(auto[0].rect) == (1.0, 0.0, 4.0, 4.0) and auto[0].image.width == 4 and auto[7].image is None
    by_size = {r.image_id: r for r in pick_crop(images, crops, auto=True, width=30, height=10, aspect=1.0).collect()}
    assert by_size[0].rect.width / by_size[0].rect.height == 3.0
    hook = lambda request: F.struct(request["bytes"].alias("bytes"), F.lit(1).alias("width"))
    assert {r.image_id: r.image for r in pick_crop(images, crops, convert=hook).collect()}[0].width == 1


def test_placeholder_defaults(spark):
    none = spark.range(1).select(*[F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("color", "long"), ("encoding", "struct<kind: string, quality: int>"))])
    image = P.placeholders(none).first().image
    assert (image.width, image.height, image.encoding.kind, image.encoding.quality) == (256, 256, "jpg", 50)
    red = none.select("width", "height", F.lit(0xFFFF0000).alias("color"), E.encoding(F.lit("png"), F.lit(None)).alias("encoding"))
    assert codec.decode_png(bytes(P.placeholders(red).first().image.bytes))[0, 0].tolist() == [255, 0, 0, 255]


def test_placeholders_are_dealt_over_all_cores(spark):
    """Requests are a few bytes each: all of a large table's lie in one task of its file."""
    asked = spark.range(0, 400, 1, 1).select(
        F.col("id"), (F.col("id") % 9 + 1).cast("int").alias("width"), F.lit(3).alias("height"), (F.col("id") * 40503).alias("color"), E.encoding(F.lit("jpg"), F.lit(75)).alias("encoding"))
    made = P.placeholders(asked).select("id", F.col("image.width").alias("width"), F.spark_partition_id().alias("task"))
    got = made.collect()
    assert len({r.task for r in got}) >= spark.sparkContext.defaultParallelism
    assert sorted((r.id, r.width) for r in got) == [(i, i % 9 + 1) for i in range(400)]


def test_sources_by_kind(spark):
    rect = "image_id long, source struct<kind: string, camera: string, path: string, bytes: binary>"
    rows = [(1, ("memory", None, None, bytearray(b"m"))), (2, ("gallery", None, "f", None)), (3, ("camera", "rear", None, None))]
    found = spark.createDataFrame([("f", bytearray(b"file"))], "path string, bytes binary")
    got = {r.image_id: r.bytes for r in files.read_sources(spark.createDataFrame(rows, rect), found).collect()}
    assert got == {1: b"m", 2: b"file", 3: None}


def test_skip_existing(spark):
    rows, have = spark.createDataFrame([("a",), ("b",)], "dst string"), spark.createDataFrame([("b",), ("b",)], "dst string")
    assert [r.dst for r in sinks.skip_existing(rows, have).collect()] == ["a"]
    assert sinks.skip_existing(rows, have, force=True).count() == 2


def test_names(spark):
    lit = F.lit
    row = one(spark, N.temp_png(lit("/t"), lit("x/image_1.tar.png"), lit(7)), N.hex_literal(lit(bytearray(b"\x00\x0f\xff"))), N.hex_literal(lit(bytearray())), N.pick_route(lit("camera"), lit("linux")))
    assert tuple(row) == ("/t/image_1.tar_7.png", "0x0,0xf,0xff", "", "file_dialog")
    long = bytearray(range(200))
    assert "\r" not in one(spark, N.data_url(lit(long)).alias("u")).u


def test_stream_equals_batch(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.makedirs(landing)
    for name, data in (("a", b"\xff\xd8\xff\xe0"), ("b", b"\x89PNG"), ("c", b"BM")):
        with open(os.path.join(landing, name), "wb") as f:
            f.write(data)
    describe_arrivals(spark, landing, out, state)
    describe_arrivals(spark, landing, out, state)
    want = sorted(map(tuple, describe(files.image_files(spark, landing)).collect()), key=str)
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == want and len(want) == 3
