"""Materialised snapshots: tables in the shared folder, which cut lineage and fix row numbers."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset and all is local."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir(spark.sparkContext.applicationId)


@functools.cache
def _own_dir(app_id: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="doclathe-snapshots-")


def snapshot(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read again; removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/doclathe-snapshot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_snapshots() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: nothing is left to clean with
            return


atexit.register(drop_snapshots)
