"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations.

A text is lower-cased and cut into words (runs of letters, digits and characters beyond ASCII); its
shingles are five words.  A test item is contained in a document if the document has at least
``CONTAINMENT`` of the item's different shingles.

Search.  Documents may be thousands of times longer than items, so the sketches are of the items: the
items are partitioned by their number of shingles, in partitions whose bounds grow by a factor of
``GROWTH``.  In a partition with items of up to u shingles each item's sketch is its s least shingles
under the MinHash order (a hash of the shingle), with s = floor((1 - CONTAINMENT) u) + 1.  A document
that holds the wanted share of an item misses at most (1 - CONTAINMENT) of its shingles, which is fewer
than s, so it holds one of the sketch: no contained item is lost.  Document shingles are looked up among
the sketches' hashes; hits are the candidates.

Verification.  Candidate documents are shingled again and their shingles, as strings, are compared with
all of the candidate item's: the containment is exact.

No sketch of a document is made: all its shingles are probed, so its size doesn't matter.

The sketches, and the items' shingles, are broadcast only after a check that they have at most ``BROADCAST_ROWS`` rows; beyond
that the lookup is a shuffled join.  Items with one text are searched once.

Defined cases: null or wordless texts have no shingles and neither contain nor are contained; fewer than
five words are one shingle, which only a text of just those words has; repeated item rows give one row
for each different item_id; repeated documents count by doc_id, which holds whatever one of its rows
holds together; documents without an id take no part in ``contained``, while ``clean`` looks at each row by
itself, with or without an id; empty tables give no rows; further columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclathe.llm.common import KEY, keyed, scratch, small, table

WORDS = 5
CONTAINMENT = 0.8
GROWTH = 1.25
BROADCAST_ROWS = 200_000
#: Runs of these separate words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(df: DataFrame, keep: str) -> DataFrame:
    """keep, w: the words of each text.  Splitting leaves an empty word where a gap is first or last.  There is no
    filter on the words: Spark would push it below and split every text again for it."""
    words = F.array_remove(F.split(F.lower(F.col("text").cast("string")), GAP), "")
    return df.filter(F.col("text").isNotNull()).select(keep, words.alias("w"))


def _positions(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each shingle: its first word's position p, with the words at hand.  Of the inner form of the
    generator Spark would infer a filter on the words; the outer form's row without a position goes here."""
    return rows.select(*keep, "w", F.posexplode_outer("w").alias("p", "_first")).filter(f"p = 0 or p + {WORDS} <= size(w)").drop("_first")


_PARTS = [f"get(w, p + {i})" for i in range(WORDS)]
#: Words never hold the separator, and words beyond a short text are null and count as nothing.
_HASH = f"xxhash64({', '.join(_PARTS)})"
_TEXT = f"concat_ws(' ', {', '.join(_PARTS)})"


def shingles(df: DataFrame, keep: str) -> DataFrame:
    """keep, h, shingle: the different shingles of each id."""
    return _positions(_words(df, keep), keep).select(keep, F.expr(_TEXT).alias("shingle"), F.expr(_HASH).alias("h")).distinct()


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """items: item, h, shingle -> item, h, n_item: the sketch of each item, of the size that its partition needs."""
    import math

    n = items.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    sized = items.join(n, "item")
    # Partition t holds sizes up to u = floor(GROWTH ** t).
    t = F.ceil(F.log(F.col("n_item").cast("double")) / math.log(GROWTH) - 1e-9)
    u = F.greatest(F.col("n_item"), F.floor(F.pow(F.lit(GROWTH), t)))
    size = F.floor(u * (1 - containment) + 1e-9) + 1
    w = Window.partitionBy("item").orderBy(F.hash("h"), "h")
    return sized.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= size).select("item", "h", "n_item")


def _lookup(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows joined with keys on h; keys are broadcast if a check finds them few enough, else shuffled."""
    return rows.join(F.broadcast(keys) if small(keys, BROADCAST_ROWS) else keys, "h")


def _contained(docs: DataFrame, benchmark: DataFrame, containment: float) -> DataFrame:
    """docs: doc (of any type, not null), text -> doc, item_id, n_shared, n_item."""
    tests = scratch(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct())
    # Items of equal texts go by the least id.
    once = tests.join(tests.groupBy("text").agg(F.min("item_id").alias("item")), "text")
    items = scratch(shingles(once.select("item", "text").distinct(), "item"))
    sketch = scratch(sketches(items, containment))
    hits = _lookup(_positions(_words(docs, "doc"), "doc").select("doc", F.expr(_HASH).alias("h")), sketch.select("item", "h"))
    candidates = scratch(hits.select("doc", "item").distinct())
    # The second pass shingles the texts of candidate documents only, and keeps what any item has.
    again = docs.join(candidates.select("doc").distinct(), "doc", "left_semi")
    # The text is taken before the lookup, as rows that are shuffled must not carry all words of a document.
    near = _positions(_words(again, "doc"), "doc").select("doc", F.expr(_HASH).alias("h"), F.expr(_TEXT).alias("_text"))
    have = _lookup(near, items).filter(F.col("_text") == F.col("shingle")).select("doc", "item", "shingle").distinct()
    sizes = sketch.select("item", "n_item").distinct()
    shared = have.join(candidates, ["doc", "item"]).groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n_shared"))
    found = shared.join(sizes, "item").filter(F.col("n_shared") >= F.col("n_item") * containment - 1e-9)
    named = found.join(once.select("item", "item_id").distinct(), "item")
    return named.select("doc", "item_id", "n_shared", "n_item").distinct()


def contained(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: the test items that each document contains."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).filter("doc is not null")
    found = _contained(rows, benchmark, containment)
    return found.select(F.col("doc").alias("doc_id"), "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows, with all their columns, that contain no test item."""
    rows = keyed(docs)
    found = _contained(rows.select(F.struct(*KEY).alias("doc"), F.col("text").cast("string").alias("text")), benchmark, containment)
    bad = found.select(*(F.col(f"doc.{k}").alias(k) for k in KEY)).distinct()
    return rows.join(bad, KEY, "left_anti").select(*docs.columns)


def op9_minhash_containment(spark, sf_dir):
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_shingles(relation: str, id_: str) -> str:
    return rf"""
  SELECT DISTINCT id, CASE WHEN len(w) < {WORDS} THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + {WORDS - 1}], ' ') END AS s
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS p
        FROM (SELECT {id_} AS id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {relation}) WHERE len(w) > 0)"""


SQL = f"""
WITH d AS ({_sql_shingles("documents", "doc_id")}
), b AS ({_sql_shingles("benchmark", "item_id")}
), n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM d JOIN b ON d.s = b.s JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= {CONTAINMENT} * any_value(n_item) - 1e-9
"""
