"""Image sources: files, decoded images, bytes in columns, request rows and landing folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import loaded_side
from ..schema import FILE, SOURCE


def image_files(spark: SparkSession, path: str, *, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, bytes): one row a file; bytes are read only if a query uses them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).withColumnRenamed("content", "bytes")


def decoded_files(spark: SparkSession, path: str, *, drop_invalid: bool = False) -> DataFrame:
    """Spark's image source with an ``error`` column: the JVM's codecs, progressive JPG included, WebP not."""
    rows = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path)
    bad = F.col("image.width") < 0
    sides = [loaded_side(F.col(f"image.{a}"), F.col(f"image.{b}")).alias(a) for a, b in (("width", "height"), ("height", "width"))]
    return rows.select("image", F.col("image.origin").alias("path"), *sides, F.when(bad, "decode_failed").alias("error"))


def memory_images(spark: SparkSession, images: list[tuple[int, bytes]]) -> DataFrame:
    """(image_id, bytes) of images at hand."""
    return spark.createDataFrame([(i, bytearray(b)) for i, b in images], "image_id long, bytes binary")


def landing_stream(spark: SparkSession, path: str, *, glob: str = "*") -> DataFrame:
    """Files as they arrive in a folder (cameras, uploads), as a stream of the same rows as ``image_files``."""
    reader = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.load(path).withColumnRenamed("content", "bytes")


def read_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes of sources (``source`` struct): memory as it is, the others from ``files`` by path.

    A source that was not picked, or whose file is missing, has null bytes.  Sources are dealt to the files
    (:func:`narrow_join`), so bytes of files stay in the tasks that read them, and rows of sources without a file,
    which carry none, are added.
    """
    if [f.name for f in sources.schema["source"].dataType.fields] != [f.name for f in SOURCE.fields]:
        raise ValueError("source must be " + SOURCE.simpleString())
    from_file = F.coalesce(F.col("source.kind") != "memory", F.lit(True)) & F.col("source.path").isNotNull()
    wanted = sources.where(from_file)
    found = narrow_join(files.select(F.col("path").alias("_path"), F.col("bytes").alias("_bytes")), wanted, "_path", F.col("source.path"), "inner")
    read = found.select(*[F.col(f"`{c}`") for c in sources.columns], F.col("_bytes").alias("bytes"))
    have = files.select(F.col("path").alias("_path")).distinct()
    missing = wanted.join(have, F.col("source.path") == F.col("_path"), "left_anti").withColumn("bytes", F.lit(None).cast("binary"))
    others = sources.where(~from_file).withColumn("bytes", F.when(F.col("source.kind") == "memory", F.col("source.bytes")))
    return read.unionByName(missing).unionByName(others)


#: Rows of one broadcast, and broadcasts of one join, at most.
BROADCAST_ROWS, BROADCASTS = 1_000_000, 16


def narrow_join(heavy: DataFrame, light: DataFrame, key: str, light_key: Column, how: str) -> DataFrame:
    """``heavy`` joined ("inner" or "left") with ``light`` without moving a row of ``heavy``.

    ``light`` is counted and dealt by its key's hash into broadcasts of about BROADCAST_ROWS rows.  Each heavy row
    meets one of them only.  Beyond BROADCASTS of them both sides are shuffled, for want of a bound.  Columns must differ.
    """
    n = light.count()
    parts = -(-n // BROADCAST_ROWS) or 1
    on = F.col(key) == light_key
    if parts == 1:
        return heavy.join(F.broadcast(light), on, how)
    if parts > BROADCASTS:
        return heavy.join(light, on, how)
    of = lambda c, k: F.pmod(F.xxhash64(c), F.lit(parts)) == k
    out = None
    for k in range(parts):
        mine = F.coalesce(of(F.col(key), k), F.lit(k == 0))  # null keys go with the first
        part = heavy.where(mine).join(F.broadcast(light.where(of(light_key, k))), on, how)
        out = part if out is None else out.unionByName(part)
    return out
