"""Sinks: image files through a Spark data source, with the skip-if-exists rule."""

from __future__ import annotations

import os
import posixpath
import uuid
from dataclasses import dataclass

import pyarrow.fs as pa_files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def skip_existing(rows: DataFrame, existing: DataFrame, *, dst: str = "dst", force: bool = False) -> DataFrame:
    """Rows whose ``dst`` is not among the paths of ``existing``; all rows if ``force``.

    Put it before decoding: an anti join on names, which never touches bytes.
    """
    if force:
        return rows
    have = existing.select(F.col(dst).alias("_have")).distinct()
    return rows.join(have, F.col(dst) == F.col("_have"), "left_anti")


@dataclass
class _Written(WriterCommitMessage):
    n: int


class _ImageFileWriter(DataSourceWriter):
    """Writes each row's bytes under its name, by a temporary name first, so that a retried task leaves whole files."""

    def __init__(self, folder: str, names: list[str]) -> None:
        self.folder = folder
        self.at = [names.index("name"), names.index("bytes")]

    def write(self, rows) -> _Written:
        files, base = pa_files.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else os.path.abspath(self.folder))
        n = 0
        for row in rows:
            name, data = row[self.at[0]], row[self.at[1]]
            if name is None or data is None:
                continue
            target = posixpath.normpath(posixpath.join(base, name))
            if not target.startswith(posixpath.normpath(base).rstrip("/") + "/"):
                raise ValueError(f"{name} lies outside the folder")
            files.create_dir(posixpath.dirname(target), recursive=True)
            part = f"{target}.{uuid.uuid4().hex}.part"
            try:
                with files.open_output_stream(part) as f:
                    f.write(bytes(data))
                files.move(part, target)
            except BaseException:
                if files.get_file_info(part).type != pa_files.FileType.NotFound:
                    files.delete_file(part)
                raise
            n += 1
        return _Written(n)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


class ImageFiles(DataSource):
    """``format("image_files")``: rows with ``name`` and ``bytes`` become files of a mounted folder or of a store that Arrow can write (s3, gs, hdfs)."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "name string, bytes binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ImageFileWriter(self.options["path"], [f.name for f in schema.fields])


def save_images(rows: DataFrame, folder: str) -> None:
    """Write (name, bytes) rows as files into a folder that all executors reach, by its path or address."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(ImageFiles)
    rows.select("name", "bytes").write.format("image_files").mode("append").save(folder)
