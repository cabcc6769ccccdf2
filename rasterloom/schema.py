"""Row types: encodings, rectangles, images, layers, requests, sources and rasters."""

from pyspark.sql import types as T

ENCODING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("quality", T.IntegerType())])
RECT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("left", "top", "width", "height")])
RECT_INT = T.StructType([T.StructField(n, T.IntegerType()) for n in ("left", "top", "width", "height")])
META = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("encoding", ENCODING)])
IMAGE = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("encoding", ENCODING), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])
LAYER = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("src", RECT), T.StructField("dst", RECT)])
REQUEST = T.StructType([
    T.StructField("image_id", T.LongType()), T.StructField("layers", T.ArrayType(LAYER)), T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("encoding", ENCODING)])
CROP = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("rect", RECT)])
SOURCE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("camera", T.StringType()), T.StructField("path", T.StringType()), T.StructField("bytes", T.BinaryType())])
FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
#: Spark's own image struct; rows of pixels, BGR or BGRA.
RASTER = T.StructType([
    T.StructField("origin", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
    T.StructField("nChannels", T.IntegerType()), T.StructField("mode", T.IntegerType()), T.StructField("data", T.BinaryType())])
MODE_BGR, MODE_BGRA = 16, 24

UNKNOWN_QUALITY = -1
DEFAULT_QUALITY = 50
PLACEHOLDER_SIDE = 256
