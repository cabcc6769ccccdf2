"""Scratch tables in the shared checkpoint folder and small DataFrame helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every operator here: space, tab, LF, VT, FF, CR.
SPACE_CLASS = r"[ \x09-\x0D]"
WORD_CLASS = r"[^ \x09-\x0D]"

#: Spark's setting (since 4.1) by which a query deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}

#: What empties the memos that operators keep in a Python worker, by operator.
_memos: dict[str, list[Callable[[], None]]] = {}


def keep_memo(owner: str, empty: Callable[[], None]) -> None:
    """Tell that ``owner`` keeps a memo in this process, and how it is emptied."""
    _memos.setdefault(owner, []).append(empty)


def claim_worker(owner: str) -> None:
    """Empty the memos of all other operators: Spark hands a worker of one stage to the next."""
    for other, empties in _memos.items():
        if other != owner:
            for empty in empties:
                empty()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set and there is one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="rasterloom-")
    return "file://" + _own_dirs[app]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of the shared folder, deleted at the end of the session."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at : at + (1 << 20)]))
    out.close()
    atexit.register(_remove_at_exit, spark, path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
    except Exception:  # the session is gone, and with it the right to tidy up
        pass


def write_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of what was written.

    Cuts the lineage like ``checkpoint()``, but column by column, so that later
    readers fetch only the columns they use.  Lost executors lose nothing.  The
    shuffle files of the query go when it has ended.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/rasterloom/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_remove_at_exit, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rasterloom_path = path
    return out


def few(table: DataFrame, most: int) -> DataFrame:
    """``table`` (of :func:`write_table`) marked for a broadcast if it has at most ``most`` rows, counted first, else for a hash join."""
    return F.broadcast(table) if table.count() <= most else table.hint("shuffle_hash")


def append_table(table: DataFrame, rows: DataFrame) -> None:
    """Add rows to a table of :func:`write_table`; :func:`read_again` shows them."""
    rows.write.mode("append").parquet(table._rasterloom_path)


def read_again(table: DataFrame) -> DataFrame:
    path = table._rasterloom_path
    out = table.sparkSession.read.schema(table.schema).parquet(path)
    out._rasterloom_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`write_table` that nothing reads any more."""
    path = getattr(df, "_rasterloom_path", None)
    if path:
        _remove(df.sparkSession, path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now instead of at its next collection."""
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)  # the cleaner works in its own thread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS + "++")).cast("long"), F.lit(0).cast("long"))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name
