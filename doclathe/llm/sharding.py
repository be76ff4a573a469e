"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash of the text, then of the id, and ranked; row r
of a source with n rows has the fractional rank (r + 1/2) / n.  All rows are sorted by it and the
order is cut into equal runs: every shard holds each source in proportion, and shard sizes differ by
one row at most (the law ``rows``).  As the shuffle hashes the text, equal texts of a source stand
next to each other and meet in one shard as far as the law leaves room.

Defined cases: a null text has no bytes (size 16, crc32 0); a null source is a source; equal rows may
change places with each other; an empty table gives no rows; further columns are not read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclathe.llm.common import KEY, TIE, keyed, part, placed, table
from doclathe.llm.ranking import rank_rows

SHARDS = 40
SEED = 20240607
#: Bytes counted for each document beside its text.
OVERHEAD = 16
#: Columns that deal() adds; columns of documents by these names give way.
MADE = ("size", "text_crc32", "law", "shard", "slot")


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot (from 0, gapless in the shard), grown_shard (null), and the
    columns to keep."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = placed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.lit(seed), text).alias("by_text"),
            F.xxhash64(F.lit(seed), "doc_id").alias("by_id"),
            *keep,
        )
    )
    ranked = rank_rows(rows, ["by_text", "by_id", "doc_id", TIE], "source")
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", ((2 * F.col("rank") + 1) / (2 * F.col("group_rows"))).alias("part"), *keep)
    ranked = rank_rows(ranked, ["part", "source", "doc_id"])
    n = rows.count()
    shard = F.expr(f"rank * {shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    out = ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *keep)


def deal(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All columns of documents that stand in a mixed order, with size, text_crc32, law, shard and slot.

    Shards are those of ``assign``, row by row.  Only the slots differ: they follow the mixed order, which is that of
    the files and the rows in them (of the frame, where it isn't read from files).  As a source's rows come to the
    shards by the hash of their text, a shard has rows from all along the order: each is the mix in small."""
    docs = docs.drop(*MADE)
    rows = keyed(docs)
    found = assign(rows, shards, seed, KEY).select("shard", "size", "text_crc32", "law", part().alias("_part"), *KEY)
    slots = rank_rows(found, ["_part", *KEY], "shard").select(*KEY, "size", "text_crc32", "law", "shard", F.col("rank").alias("slot"))
    return rows.join(slots, KEY).select(*docs.columns, *MADE)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the documents to ``path``/shard=K/, in slot order.  doc_id must tell documents apart."""
    found = docs.drop("shard", "slot").join(assign(docs, shards, seed).select("doc_id", "shard", "slot"), "doc_id")
    found.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def op4_stratified_sharding(spark, sf_dir):
    return assign(table(spark, sf_dir, "documents")).drop("source")
