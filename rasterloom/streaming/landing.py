"""The stateless projections over a stream of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import extension, mime_type, sniff_kind
from ..sources.files import landing_stream


def describe(files: DataFrame) -> DataFrame:
    """(path, length, kind, mime, extension) of batch or streaming file rows."""
    kind = sniff_kind(F.col("bytes"))
    return files.select("path", "length", kind.alias("kind"), mime_type(kind).alias("mime"), extension(kind).alias("extension"))


def describe_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Describe what has arrived since the last call and append it to Parquet in ``out``; exactly once for each file."""
    query = describe(landing_stream(spark, folder)).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
