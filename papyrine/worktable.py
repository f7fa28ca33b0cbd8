"""Materialised intermediate results in the folder all executors share.

``spark.checkpoint.dir`` names the folder. Where it is unset, a fresh temporary folder is used if the session runs
on one machine; a cluster must name a folder its executors share. A work table is plain parquet, so a lost executor costs nothing but the
tasks it was running, and readers prune its columns.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; one of our own only where a session on one machine names none."""
    set_by_session = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_session:
        return set_by_session.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="papyrine-")
    return _OWN[app]


def worktable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back, with the lineage cut.

    The files stay until :func:`release`, because results that are still lazy read them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/papyrine/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete every work table written by this process; returns how many were deleted."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    for folder in _OWN.values():
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)
    _OWN.clear()
    return done
