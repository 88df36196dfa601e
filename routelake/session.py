"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder (tests, one machine).
LOCAL_SCRATCH = "file:///tmp/checkpoints/routelake"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it; raises on a cluster that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Removes a query's shuffle files once it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes that a Python function gets at a time: texts can be long.
BATCH_ROWS, MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
BATCH_BYTES, MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows reads files that outlive any executor, and the shuffle
    files of the write go at its end (they are of no use to a later query).  ``discard``
    removes the table once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    held = {CLEAN_UP: "true", BATCH_ROWS: str(min(MOST_ROWS, int(spark.conf.get(BATCH_ROWS, "10000")))), BATCH_BYTES: MOST_BYTES}
    before = {key: spark.conf.get(key, None) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that have had their last reader.  Others are left alone."""
    for table in tables:
        if path := getattr(table, "_staged_at", None):
            jvm, context = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, where they would not find it by themselves."""
    package = os.path.dirname(os.path.abspath(__file__))
    root, context = os.path.dirname(package), spark.sparkContext
    found = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if root in found or context.applicationId in _SHIPPED:
        return
    target = os.path.join(tempfile.mkdtemp(), "routelake.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
