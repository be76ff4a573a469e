"""Pipelines over streams.

Stages without state ($match, $project, $addFields, $unset, $unwind, $replaceRoot, $redact) run in append
mode; $group and $count keep aggregates and run in complete or update mode.  Stages that need the order of
all rows are refused when the pipeline is compiled.  Windows by event time are $group over a bounded
watermark, with a window as part of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclathe.plans.pipeline import aggregate, validate

STATEFUL = {"$group", "$count"}


def read_stream(spark: SparkSession, path: str, schema, format: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def windowed(df: DataFrame, time: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Adds ``window`` for grouping by event time; rows later than ``late`` are given up."""
    df = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return df.withColumn("window", F.window(time, length, slide) if slide else F.window(time, length))


def run(df: DataFrame, stages, sink: str = "memory", name: str | None = None, checkpoint: str | None = None, mode: str | None = None, **options) -> StreamingQuery:
    """Start a pipeline on a stream.  mode: by default what the stages allow."""
    stateful = any(n in STATEFUL for n, _ in validate(stages))
    writer = aggregate(df, stages).writeStream.format(sink).outputMode(mode or ("complete" if stateful else "append"))
    if name:
        writer = writer.queryName(name)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.options(**options).start()
