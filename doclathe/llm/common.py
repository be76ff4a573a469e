"""What the operators share: reading tables, shipping the package, shared scratch tables."""

from __future__ import annotations

import atexit
import functools
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent.parent
_made: list[tuple[object, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="doclathe-"), "doclathe_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    spark.sparkContext.addPyFile(target)  # the driver serves it to all executors
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir(spark.sparkContext.applicationId)


@functools.cache
def _own_dir(app_id: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="doclathe-scratch-")


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, and outlives lost executors.

    The table is removed when the driver's Python ends.  With ``free`` the shuffle files of this write go as soon as
    the table is written, not when the driver's JVM next collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/doclathe-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE) if free else None
    try:
        if free:
            spark.conf.set(_FREE, "true")
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(_FREE, before)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch() -> None:
    """Remove every scratch table written so far; results that still read them must be done."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: nothing is left to clean with
            return


atexit.register(drop_scratch)


#: Columns of keyed(); tables have no columns of these names.
KEY = ["_doclathe_file", "_doclathe_row"]
TIE = "_doclathe_tie"


def keyed(df: DataFrame) -> DataFrame:
    """Adds what tells all rows apart, however equal they are, and is the same whenever ``df`` is read: the file
    and the row's place in it.  Files of a frame that Spark wrote sort in the order of its partitions by ``part``.
    A frame that isn't read from files is written first."""
    try:
        return df.select("*", F.col("_metadata.file_path").alias(KEY[0]), F.col("_metadata.row_index").alias(KEY[1]))
    except AnalysisException:
        return keyed(scratch(df))


def placed(df: DataFrame) -> DataFrame:
    """A table in the shared folder with ``TIE``, a hash of each row's place in its files: the same whenever the row is
    read, it lets equal rows be cut apart when rows are dealt out by range."""
    return scratch(df).select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(TIE))


def part():
    """The number of the partition that the file of keyed() was written from; null for files of other names."""
    return F.regexp_extract(KEY[0], "/part-([0-9]{1,18})[^/]*$", 1).try_cast("long")


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def held_out(col: str, n: int, remainder: int):
    """Whether crc32 of a number written as text has that remainder modulo n; never for null ids."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % n == remainder, F.lit(False))
