"""Exact ranks of all rows and of the rows of each group, without any one-task window over the data.

Rows are range-partitioned and sorted, numbered inside their partition, and shifted by the counts of
the partitions before.  Only those counts (one row for each partition and group) are summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclathe.llm.common import scratch

LOW33 = (1 << 33) - 1


def rank_rows(df: DataFrame, order: list[str], group: str | None = None) -> DataFrame:
    """Adds ``rank`` (from 0, over all rows by [group, *order]) or, with a group, ``rank`` within the group
    and ``group_rows``.  ``order`` should tell rows apart (see ``common.placed``): rows equal in it go to one task."""
    keys = [*([group] if group else []), *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = scratch(placed.withColumn("_at", F.monotonically_increasing_id()))
    at = {"_pid": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND(LOW33)}
    placed = placed.withColumns(at).drop("_at")
    by = ["_pid", *([group] if group else [])]
    parts = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_low"))
    w = Window.partitionBy(*([group] if group else [])).orderBy("_pid")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_low")
    parts = parts.withColumn("_shift", before)
    if group:
        parts = parts.withColumn("group_rows", F.sum("_n").over(Window.partitionBy(group)))
        parts = parts.select("_pid", F.col(group).alias("_g"), "_shift", "group_rows")
        joined = placed.join(parts, (placed["_pid"] == parts["_pid"]) & placed[group].eqNullSafe(parts["_g"]))
        return joined.select(*[placed[c] for c in df.columns], (F.col("_pos") + F.col("_shift")).alias("rank"), "group_rows")
    return placed.join(parts.select("_pid", "_shift"), "_pid").select(*df.columns, (F.col("_pos") + F.col("_shift")).alias("rank"))
