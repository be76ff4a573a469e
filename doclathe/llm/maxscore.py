"""Exact top-k search by MaxScore over vectors, shard by shard.

A component d of a vector, scaled and rounded down to an integer, makes two terms: (d, +) if it is
positive, (d, -) if negative.  What a term can add to a query's inner product is at most the query's
component times the largest magnitude in the term's postings of the block at hand; terms whose sign
disagrees with the query's add nothing positive, so the bound of d is that of its agreeing term.

For each query the terms are sorted by bound.  While the sum of the smallest bounds stays below the k-th
best score found so far those terms are non-essential: a vector that gains nothing from the essential
ones can't enter the result.  Essential postings are traversed for all queries of a chunk at once - vectors
are dense, so postings are rows of a matrix and the traversal is a matrix product with the other terms'
weights at zero.  The other terms are probed, largest bounds first, and only for what still competes:
down to ``SPARSE`` of the threshold as a second product, the rest vector by vector.  The block's best raise
the threshold for the next block; the k best of each shard are merged.

Index shards are of about ``SHARD`` vectors, each searched by blocks of about ``QUERIES`` queries, so no task
holds more than one of each; the query set is stated, and never gathered on the driver.  Vectors are
copied once for each block of queries, queries once for each shard.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, neither as
a query nor as a candidate; shorter vectors count as padded with zeros; rows that share a vec_id are
queries and candidates each on its own, a query's own row excepted; a null vec_id is no query, and a
candidate that comes last among ties; scores beyond 64 bits are held at its ends; ties go to the smaller
vec_id; fewer than k candidates are all returned; an empty table gives no rows; further columns are not
read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclathe.llm.common import scratch, ship, table

TOP = 10
SCALE = 1024
SHARD = 8192
QUERIES = 8192
#: Queries handled together, and vectors of a block; the first block is small, for a first threshold.
CHUNK, HEAD, BLOCK = 256, 256, 4096
#: Terms whose bounds sum up to less than this share of the threshold are probed vector by vector.
SPARSE = 0.125
PAIRS = 1 << 16
LOW, HIGH = -(1 << 63), (1 << 63) - 1


class Best:
    """The k best of each query so far: scores (worst possible where there are fewer) and places, in order."""

    def __init__(self, queries: int, k: int, kind):
        self.k = k
        self.scores = np.full((queries, k), -np.inf, kind)
        self.places = np.full((queries, k), -1)

    def threshold(self) -> np.ndarray:
        """What a vector must reach; nothing where it could still enter anyhow."""
        last = self.scores[:, -1]
        return np.where((self.places[:, -1] < 0) | (last <= LOW), -np.inf, last)

    def add(self, query: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        here = np.unique(query)
        if not len(here):
            return
        old = self.places[here] >= 0
        q = np.concatenate([np.repeat(here, old.sum(axis=1)), query])
        p = np.concatenate([self.places[here][old], place])
        s = np.concatenate([self.scores[here][old], score])
        # Numbers that sort as the scores do, as scores may be Python's integers.
        order = np.lexsort((p, -np.unique(s, return_inverse=True)[1], q))
        q, p, s = q[order], p[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.scores[here], self.places[here] = -np.inf, -1
        self.scores[q[top], rank[top]], self.places[q[top], rank[top]] = s[top], p[top]


def _traverse(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, rows: np.ndarray, at: int, best: Best) -> None:
    """One block of vectors, the first of which has place ``at``."""
    zero = vectors.dtype.type(0) if vectors.dtype != object else 0
    high, low = np.maximum(vectors.max(axis=0), zero), np.minimum(vectors.min(axis=0), zero)
    bound = np.where(queries > 0, queries * high, queries * low)
    order = np.argsort(-bound, axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(bound, order, axis=1)[:, ::-1], axis=1)[:, ::-1]
    rest = np.concatenate([sums, np.full((len(queries), 1), zero)], axis=1)  # rest[i]: most that terms i.. can add
    line = best.threshold()[:, None]
    essential = (rest[:, :-1] >= line).sum(axis=1, keepdims=True)
    dense = np.maximum(essential, (rest[:, :-1] > line * SPARSE).sum(axis=1, keepdims=True))
    most = lambda n: np.take_along_axis(rest, n, axis=1)
    score = np.where(place < essential, queries, zero) @ vectors.T
    alive = (score + most(essential) >= line) & (own[:, None] != rows[None, :])
    if (dense > essential).any():
        score += np.where((place >= essential) & (place < dense), queries, zero) @ vectors.T
        alive &= score + most(dense) >= line
    last = np.where(place >= dense, queries, zero)
    query, where = np.nonzero(alive)
    full = score[query, where]
    for a in range(0, len(query) if last.any() else 0, PAIRS):
        q, v = query[a : a + PAIRS], where[a : a + PAIRS]
        full[a : a + PAIRS] += (last[q] * vectors[v]).sum(axis=1)
    full = np.clip(full, LOW, HIGH) if vectors.dtype == object else full
    keep = np.asarray(full >= line[query, 0], bool)
    best.add(query[keep], where[keep] + at, full[keep])


def search(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, rows: np.ndarray, k: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place and score of the k best; equal scores go to the vector that comes first.
    own and rows: numbers of the rows that queries and vectors come from."""
    found = []
    edges = [0, *range(min(HEAD, len(vectors)), len(vectors), BLOCK), len(vectors)]
    for a in range(0, len(queries), CHUNK):
        best = Best(len(queries[a : a + CHUNK]), k, vectors.dtype)
        for x, y in zip(edges, edges[1:]):
            if y > x:
                _traverse(queries[a : a + CHUNK], own[a : a + CHUNK], vectors[x:y], rows[x:y], x, best)
        q, i = np.nonzero(best.places >= 0)
        found.append((q + a, best.places[q, i], best.scores[q, i]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int),) * 3


def to_matrix(lists) -> np.ndarray:
    """Whole numbers of equal length, as doubles; as Python's integers where sums of products could pass 2 ** 53."""
    flat, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets)
    lengths = np.diff(ends)
    width = int(max(lengths.max(initial=0), 1))
    top = np.abs(flat).max(initial=0)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)] = flat
    return out if top * top * width < 1 << 53 else np.vectorize(int, otypes=[object])(out)


def _search_cells(key, cell):
    """One shard and one block of queries: a row for each of the k best."""
    cell = cell.combine_chunks().sort_by([("vec_id", "ascending"), ("row", "ascending")])  # null ids last
    m = to_matrix(cell.column("v").combine_chunks())
    is_query = np.asarray(cell.column("is_query").combine_chunks().to_numpy(zero_copy_only=False), bool)
    row, ids = cell.column("row").to_numpy(), cell.column("vec_id").combine_chunks()
    vectors, queries = np.flatnonzero(~is_query), np.flatnonzero(is_query)
    q, p, s = search(m[queries], row[queries], m[vectors], row[vectors])
    taken, of = pa.array(vectors[p]), pa.array(queries[q])
    return pa.table({"query_row": row[queries[q]], "query_id": ids.take(of), "row": row[vectors[p]], "vec_id": ids.take(taken), "score": pa.array([int(x) for x in s], pa.int64())})


def top_k(vectors: DataFrame, every: int = 100) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``every``: query_id, rank (from 1), vec_id, score."""
    ship(vectors.sparkSession)
    x = F.col("embedding").cast("array<double>")
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    # floor() of a double stays a double here, so that no component is out of a long's range.
    whole = F.transform("x", lambda c: F.when(F.abs(c) < 2.0**50, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE))
    data = scratch(clean.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("v")))
    queries = data.filter(F.pmod("vec_id", F.lit(every)) == 0)
    shards = -(-data.count() // SHARD)
    blocks = -(-queries.count() // QUERIES)
    if not shards or not blocks:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    spread = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = data.select(spread(1, shards).alias("shard"), "row", "vec_id", "v").select("shard", every_of(blocks).alias("block"), "row", "vec_id", "v", F.lit(False).alias("is_query"))
    right = queries.select(spread(2, blocks).alias("block"), "row", "vec_id", "v").select(every_of(shards).alias("shard"), "block", "row", "vec_id", "v", F.lit(True).alias("is_query"))
    cells = left.unionByName(right).groupBy("shard", "block").applyInArrow(_search_cells, "query_row long, query_id long, row long, vec_id long, score long")
    # Each map task keeps k rows of a query before the shuffle (Spark limits the groups of a ranking early).
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP).select("query_id", "rank", "vec_id", "score")


def op6_maxscore_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH clean AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id % 100 = 0 AND q.r <> c.r
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
