"""Session configuration, and the package for executors that don't have it."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from .sources.store import folder

#: For a cluster; sizes of partitions are targets that adaptive execution works to.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``spark.checkpoint.dir`` should name a folder that all executors share."""
    b = SparkSession.builder.appName("engramspark").config(map=CONF | conf)
    return (b.master(master) if master else b).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python, once per application: they need not have it installed."""
    sc = spark.sparkContext
    name = f"engramspark-{sc.applicationId}.zip"
    if any(os.path.basename(str(f)) == name for f in sc._python_includes):
        return
    root, out = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for top, _, files in os.walk(os.path.join(root, "engramspark")):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.relpath(full, root))
    path = f"{folder(spark)}/{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    stream.write(out.getvalue())
    stream.close()
    sc.addPyFile(path)
