"""Session helpers shared by every operator: shipping the package to executors, and scratch tables.

Executors and the driver share only the folder named in ``spark.checkpoint.dir``, the warehouse and
the inputs, so anything cut out of a plan is written below that folder as a table that any executor
can read again after another one is lost.
"""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()
_scratch: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers of executors that don't have the repository."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("strandspark", os.path.relpath(full, root)))
    place = os.path.join(tempfile.mkdtemp(prefix="strandspark-"), "strandspark.zip")
    with open(place, "wb") as f:  # addPyFile serves it to executors through the driver's file server
        f.write(buf.getvalue())
    spark.sparkContext.addPyFile(place)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Where that is unset it is a temporary one if Spark runs in this process alone, and an error on a cluster, whose
    executors would not find a folder of the driver's own.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
            if not local:
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="strandspark-checkpoint-")
            spark.sparkContext.setCheckpointDir(base)
        _scratch[app] = f"{base.rstrip('/')}/strandspark-{app}"
        atexit.register(drop, spark, _scratch[app])
    return _scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Spark's own file system layer; a missing one is fine."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # at interpreter exit the JVM may be gone already
        if spark.sparkContext._jsc is not None:
            raise


def write_scratch(df: DataFrame, label: str) -> str:
    """Write ``df`` once to the shared folder and return the place.

    Its shuffle files go as soon as it is written; else they stay until the driver happens to collect its garbage.
    """
    conf, path = df.sparkSession.conf, scratch_path(df.sparkSession, label)
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table in the shared folder: lineage ends there, lost executors don't matter."""
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(write_scratch(df, label))
