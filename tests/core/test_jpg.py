"""JPG decoding against the JVM's codec, which also writes the files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import codec, jpg_reader
from rasterloom.operators.compose import draw, image_meta, resize_images, with_alpha
from rasterloom.queries import QUERIES


def java_jpg(spark, pixels, quality=0.9, progressive=False, gray=False):
    """A JPG file of ``pixels`` by the JVM's writer (subsampled), and its pixels by the JVM's reader."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    h, w, _ = pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if gray else 5)
    packed = (pixels[:, :, 0].astype(int) << 16 | pixels[:, :, 1].astype(int) << 8 | pixels[:, :, 2]).astype(int).ravel().tolist()
    array = gateway.new_array(jvm.int, w * h)
    for i, v in enumerate(packed):
        array[i] = v
    image.setRGB(0, 0, w, h, array, 0, w)
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    ask = writer.getDefaultWriteParam()
    ask.setCompressionMode(2)
    ask.setCompressionQuality(float(quality))
    if progressive:
        ask.setProgressiveMode(1)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), ask)
    stream.flush()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    if gray:  # getRGB would brighten it
        samples = np.array(list(back.getRaster().getSamples(0, 0, w, h, 0, gateway.new_array(jvm.int, w * h)))).reshape(h, w, 1)
        return data, np.repeat(samples, 3, axis=2).astype(np.uint8)
    got = np.array(list(back.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w) & 0xFFFFFF
    return data, np.dstack([got >> 16, got >> 8 & 255, got & 255]).astype(np.uint8)


def picture(h, w):
    y, x = np.mgrid[0:h, 0:w]
    return np.dstack([x * 255 // max(1, w - 1), y * 255 // max(1, h - 1), (x + y) * 255 // max(1, h + w - 2)]).astype(np.uint8)


@pytest.mark.parametrize("size", [(1, 1), (8, 8), (16, 16), (17, 33), (50, 31)])
@pytest.mark.parametrize("progressive", [False, True])
def test_equals_the_jvm_reader(spark, size, progressive):
    data, want = java_jpg(spark, picture(*size), progressive=progressive)
    assert (b"\xff\xc2" in data) == progressive
    got = codec.decode(data)
    assert got.shape == want.shape
    # Sums and colours are rounded at other steps there.
    assert np.abs(got.astype(int) - want).mean() < 1.5
    gray, want = java_jpg(spark, picture(*size), progressive=progressive, gray=True)
    assert np.abs(codec.decode(gray).astype(int) - want).max() <= 2


def test_noise_in_progressive_scans(spark):
    noise = np.repeat(np.random.default_rng(1).integers(0, 256, (40, 48, 1)), 3, axis=2).astype(np.uint8)
    for quality in (0.3, 0.95):
        for progressive in (False, True):
            data, want = java_jpg(spark, noise, quality, progressive, gray=True)
            assert np.abs(codec.decode(data).astype(int) - want).max() <= 2


def test_own_writing_reads_back():
    for size in ((1, 1), (9, 20), (64, 64)):
        pixels = picture(*size)
        assert np.abs(codec.decode(codec.encode_jpg(pixels, 95)).astype(int) - pixels).mean() < 3
    flat = np.full((48, 48, 3), 120, np.uint8)
    assert (codec.decode(codec.encode_jpg(flat, 75)) == 120).all()


def test_cut_and_broken_files_are_errors(spark):
    data, _ = java_jpg(spark, picture(40, 40), progressive=True)
    rows = [(0, data), (1, data[: len(data) // 2]), (2, data[:20]), (3, b"\xff\xd8\xff"), (4, data[:200] + bytes(400) + data[600:])]
    files = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "i int, bytes binary")
    meta = {r.i: r.meta for r in image_meta(files, mode="strict").collect()}
    assert (meta[0].width, meta[0].height, meta[0].error) == (40, 40, None)
    assert all(meta[i].error for i in (1, 2, 3))


def test_resizing_a_progressive_file(spark):
    data, _ = java_jpg(spark, picture(64, 64), progressive=True)
    files = spark.createDataFrame([(bytearray(data),)], "bytes binary")
    crop = F.struct(F.lit(8.0).alias("left"), F.lit(8.0).alias("top"), F.lit(48.0).alias("width"), F.lit(48.0).alias("height"))
    for width, height, cut, want in ((None, None, crop, (48, 48)), (48, None, None, (48, 48)), (1, 1, None, (1, 1)), (500, 200, None, (500, 200))):
        for kind in ("png", "jpg"):
            (image,) = (r.image for r in resize_images(files, width=F.lit(width), height=F.lit(height), crop=cut, kind=kind).collect())
            assert image.error is None and (image.width, image.height) == want
            assert codec.decode(bytes(image.bytes)).shape[:2] == want[::-1]


def test_code_tables_are_as_long_as_their_codes_and_kept():
    """A file of few short codes must not cost a table of 65,536 entries each."""
    rng = np.random.default_rng(5)
    for longest in (0, 1, 3, 9, 16):
        counts, room = [0] * 16, 1
        for size in range(1, longest + 1):
            room *= 2
            counts[size - 1] = 1 if size == longest else min(room - 1, 15, int(rng.integers(0, 2)))
            room -= counts[size - 1]
        symbols = bytes(rng.integers(0, 256, sum(counts)).tolist())
        wide, table = jpg_reader._lookup(bytes(counts), symbols)
        assert wide == longest and len(table) == 1 << longest
        assert jpg_reader._lookup(bytes(counts), symbols)[1] is table
        code, left, want = 0, iter(symbols), {}
        for size in range(1, 17):
            for _ in range(counts[size - 1]):
                want[f"{code:0{size}b}"] = size << 8 | next(left)
                code += 1
            code <<= 1
        for i, got in enumerate(table):
            bits = f"{i:0{longest}b}" if longest else ""
            assert got == next((v for c, v in want.items() if bits.startswith(c)), 0)
    for counts in (bytes([3] + [0] * 15), bytes([1, 3] + [0] * 14), bytes([0, 2] + [0] * 14)):
        with pytest.raises(jpg_reader.JpgError):
            jpg_reader._lookup(counts, b"a" if counts[1] == 2 else b"abcdef")


def test_planes_at_once_and_one_by_one(monkeypatch):
    data = codec.encode_jpg(picture(37, 50), 80)
    together = codec.decode(data)
    monkeypatch.setattr(jpg_reader, "TOGETHER", 0)
    assert (codec.decode(data) == together).all()


@pytest.mark.parametrize("quality", [0, 1, 25, 50, 75, 95, 100])
def test_images_of_one_colour_are_written_as_any_other(quality):
    rng = np.random.default_rng(quality)
    for size in ((1, 1), (8, 8), (9, 1), (3, 17), (17, 256), (64, 72)):
        for channels in (3, 4):
            for color in [[0] * channels, [255] * channels, *rng.integers(0, 256, (6, channels)).tolist()]:
                flat = np.empty((*size, channels), np.uint8)
                flat[:] = color
                want = codec._any_jpg(flat, quality)
                assert codec._flat_jpg(tuple(color), size[1], size[0], quality) == codec.encode_jpg(flat, quality) == want


def test_opaque_layers_are_laid_as_by_their_alpha():
    """Shining through is not reckoned where nothing does; the pixels are those of the sum."""
    rng = np.random.default_rng(3)
    for channels in (3, 4):
        layer, canvas = rng.integers(0, 256, (7, 5, channels), dtype=np.uint8), rng.integers(0, 256, (6, 9, 4), dtype=np.uint8)
        if channels == 4:
            layer[:, :, 3] = 255
        before = canvas.copy()
        draw(canvas, layer, (0, 0, 5, 7), (2, -1, 10, 6))
        for y in range(6):
            for x in range(9):
                inside = x >= 2 and y < 5
                assert (canvas[y, x] == (with_alpha(layer)[(y + 1) * 7 // 6, (x - 2) * 5 // 10] if inside else before[y, x])).all()


@pytest.mark.parametrize("name", ["q41_jpg_pixels", "q30_resize_e2e"])
def test_pictures_made_of_narrow_rows_are_dealt_over_all_cores(spark, name):
    made = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
