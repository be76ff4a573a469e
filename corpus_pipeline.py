"""From raw documents to shards for training: five stages, each a Parquet table made from the one before.

1. Language: documents in none of the learned languages go (null, letterless or undecodable text).
2. Near copies: of each group of linked fingerprints the document with the smallest id stays.
3. Decontamination: documents that contain a benchmark item go.
4. Mixing: the rows are put in the order of a Pfair schedule of their sources.
5. Sharding: each document gets its shard and slot.  Shards are those of the sharding operator: fractional ranks
   within the sources, cut into equal runs.  Slots follow the mixed order, so each shard reads like the mix.

The first four return the columns of documents; the last adds size, text_crc32, law, shard and slot.
No stage changes a text.  The last two stages pass the order on in the files: by part and by row in it.
Repeated and null ids are documents like others to all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doclathe.llm import contamination, langid, mixing, sharding, simhash
from doclathe.llm.common import scratch, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known_language(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.deal(docs)


STAGES = [
    ("language identification", keep_known_languages),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_sources),
    ("stratified sharding", assign_shards),
]
#: Partial matching and XXH64 have no SQL form; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir))
    return docs
