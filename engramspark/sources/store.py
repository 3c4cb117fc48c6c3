"""Tables in the shared folder that ``spark.checkpoint.dir`` names: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where the setting is unset, one of our own: on one machine only, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="engram-")
        spark.conf.set("spark.checkpoint.dir", found)
        _paths.append((spark, found))
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again; it goes when the driver ends, or earlier by ``discard``."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def discard() -> None:
    """Delete the tables that were written, those that nothing reads any more: all of them when the driver ends."""
    while _paths:
        spark, path = _paths.pop()
        try:
            if spark._jsc.sc().isStopped():
                raise RuntimeError("stopped")
            remove(spark, path)
        except Exception:  # the session is gone: what is on this machine can still be deleted
            if path.startswith("file:/"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
