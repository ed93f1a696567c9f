"""The shared folder and tables staged in it."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


_made = threading.local()
# With it a finished command deletes the shuffle files of its own plan; without it they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    The result has no lineage, so lost executors cost a re-read and never a
    recomputation; row tags such as partition ids are fixed from here on. The shuffle files of
    the write are deleted with its end: no other plan reads them. ``codec`` is the
    table's compression, the session's if none is named.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_made, "paths", None) is not None:
        _made.paths.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def stage_last(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage what ``build`` returns and delete the tables that it staged on its way there."""
    outer, _made.paths = getattr(_made, "paths", None), []
    try:
        found = stage(build(), name)
        *passing, last = _made.paths
    finally:
        _made.paths = outer
    if outer is not None:
        outer.append(last)
    for path in passing:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return found
