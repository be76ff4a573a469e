"""SimHash near-dedup: fingerprints of word shingles, and bit-sliced comparison.

Words are lower-cased (A-Z only) runs of anything but ASCII white space; a shingle is three words
joined by a space.  Fingerprints that differ in two bits or fewer are linked; a component is what
links reach.

The comparison is exact.  With radius r the bits are cut into blocks so that two linked
fingerprints agree on some choice of blocks (pigeonhole); equal choices form a bucket.  In a bucket
the bit planes of all members are stored vertically, and saturating carry-save counters update 64
distances with each word operation; a block is abandoned once all its lanes exceed the radius.
Equal fingerprints are grouped before that, so copies cost nothing.  A bucket with more than
``BUCKET`` different fingerprints is split by further bits: linked ones agree on one of three parts of
the bits that the bucket left open, and so on until buckets are small; as its members differ in open
bits only, a few rounds always do.  From each bucket go only the edges of a spanning star, not all pairs.

Defined cases: null or wordless text has fingerprint 0 and is linked like any other; fewer than
three words are one shingle; repeated rows give repeated rows; an empty table gives an empty
result; further columns are not read."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclathe.llm.common import KEY, keyed, scratch, ship
from doclathe.llm.components import components

SEED = 42
WORDS = 3
RADIUS = 2
#: Most different fingerprints of one bucket that are compared with each other.
BUCKET = 2048
FULL = (1 << 64) - 1


def fingerprint(text: str | None) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches):
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row, and the columns to keep."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    kept = "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in keep)
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long" + kept)


def block_plan(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """Which bits (shift, width) form each bucket key, by how many fingerprints there are: of k + radius
    blocks, some k agree.  More fingerprints get wider keys, so buckets stay small; every plan is exact."""
    k = 1 if n < 1 << 22 else 2 if n < 1 << 30 else 3
    cuts = [64 * i // (k + radius) for i in range(k + radius + 1)]
    blocks = list(itertools.pairwise(cuts))
    return [[(a, b - a) for a, b in c] for c in itertools.combinations(blocks, k)]


def planes_of(x: np.ndarray) -> np.ndarray:
    """(64, words) bit planes of 64-bit values; lane i is bit i % 64 of word i // 64."""
    n = -len(x) % 64
    x = np.concatenate([x, np.zeros(n, np.uint64)]) if n else x
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def _unused(n: int, words: int) -> np.ndarray:
    """Words with the lanes set that hold no value."""
    out = np.zeros(words, np.uint64)
    if n % 64:
        out[-1] = np.uint64(FULL << n % 64 & FULL)
    return out


def near(mismatch, dead: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Words with the lanes set that mismatch in at most ``radius`` of the 64 planes.

    mismatch(plane, blocks): the words of the blocks still at work; a block is a word of 64 lanes.  dead: lanes that
    are out from the start.  Counters have as many bit slices as radius + 1 needs.  Once all lanes of a block
    exceed the radius the block is abandoned: its planes are read no further."""
    live = np.arange(len(dead))
    out = np.full(len(dead), FULL, np.uint64)
    dead = dead.copy()
    slices = [np.zeros(len(dead), np.uint64) for _ in range((radius + 1).bit_length())]
    for b in range(64):
        carry = mismatch(b, live)
        for i, s in enumerate(slices):
            slices[i], carry = s ^ carry, s & carry
        over = ~np.zeros_like(dead)
        for k, s in enumerate(slices):  # the count radius + 1
            over &= s if (radius + 1) >> k & 1 else ~s
        dead |= carry | over
        if b % 4 == 3:
            keep = dead != FULL
            if not keep.all():
                live, dead, slices = live[keep], dead[keep], [s[keep] for s in slices]
                if not len(live):
                    break
    out[live] = dead
    return ~out


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """A boolean matrix: which of a are within the radius of which of b."""
    planes = planes_of(b)
    words = planes.shape[1]
    out = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), 256):
        probe = a[at : at + 256]
        masks = np.where((probe[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), np.uint64(FULL), np.uint64(0))
        found = near(lambda i, blocks: planes[i][blocks % words] ^ masks[blocks // words, i], np.tile(_unused(len(b), words), len(probe)), radius)
        out[at : at + 256] = _lanes(found.reshape(len(probe), words), len(b))
    return out


def _stars(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, first member) of each component of a symmetric boolean matrix."""
    left, edges = np.ones(len(adjacent), bool), []
    for i in range(len(adjacent)):
        if left[i]:
            seen = np.zeros(len(adjacent), bool)
            seen[i] = True
            front = seen
            while front.any():
                fresh = adjacent[front].any(axis=0) & ~seen
                seen |= fresh
                front = fresh
            left &= ~seen
            edges += [(int(j), i) for j in np.flatnonzero(seen) if j != i]
    return edges


def bucket_edges(bucket: np.ndarray, fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between nodes of equal bucket (rows sorted by it)."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(bucket)])
    us, vs = [], []
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64]):
        part, names = fp[s : s + n], node[s : s + n]
        for i, j in _stars(close_pairs(part, part)):
            us.append(names[i])
            vs.append(names[j])
    is_small = np.repeat(sizes <= 64, sizes)
    which = np.repeat(np.arange(len(sizes)), sizes)
    u, v = np.array(us, np.int64), np.array(vs, np.int64)
    for shift in range(1, int(sizes[sizes <= 64].max(initial=1))):
        i = np.flatnonzero((which[:-shift] == which[shift:]) & is_small[shift:])
        if not len(i):
            break
        planes = planes_of(fp[i] ^ fp[i + shift])
        hit = i[_lanes(near(lambda b, blocks: planes[b][blocks], _unused(len(i), planes.shape[1])), len(i))]
        u, v = np.r_[u, node[hit]], np.r_[v, node[hit + shift]]
    return u, v


def _edge_batches(batches):
    """Rows come sorted by bucket; a bucket may run over several batches."""
    kept: list[np.ndarray] | None = None
    for b in batches:
        cols = [np.asarray(b.column(i)) for i in range(3)]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        kept = [c[cut:] for c in cols]
        if cut:
            yield _edges([c[:cut] for c in cols])
    if kept is not None and len(kept[0]):
        yield _edges(kept)


def _edges(cols: list[np.ndarray]) -> pa.RecordBatch:
    bucket, fp, node = cols
    u, v = bucket_edges(bucket, fp.view(np.uint64), node)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def finer(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks that hold the bits of ``mask`` and one of radius + 1 parts of the others."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in itertools.pairwise(cuts)]


def links(nodes: DataFrame, n: int) -> DataFrame:
    """nodes: fp, node (different fingerprints) -> u, v: edges that connect exactly what links connect."""
    masks = [sum((1 << w) - 1 << a for a, w in blocks) for blocks in block_plan(n)]
    found, rows = [], nodes.select("fp", "node", F.lit(None).cast("int").alias("of"))
    while True:
        # A row's key is its bits under each mask that refines its last one.
        table_ = F.array(*(F.lit(_signed(m)) for m in masks))
        each = F.sequence(F.lit(0), F.lit(len(masks) - 1)) if not found else F.sequence(F.col("of") * (RADIUS + 1), F.col("of") * (RADIUS + 1) + RADIUS)
        keyed_ = rows.select("fp", "node", F.explode(each).alias("of"))
        keyed_ = keyed_.withColumn("bucket", F.xxhash64("of", F.col("fp").bitwiseAND(F.element_at(table_, F.col("of") + 1))))
        hot = scratch(keyed_.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET).select("bucket"))
        any_hot = bool(hot.limit(1).count())
        cold = keyed_.join(hot, "bucket", "left_anti") if any_hot else keyed_
        dealt = cold.select("bucket", "fp", "node").repartition("bucket").sortWithinPartitions("bucket")
        found.append(dealt.mapInArrow(_edge_batches, "u long, v long"))
        if not any_hot:
            return reduce(DataFrame.union, found)
        rows = scratch(keyed_.join(hot, "bucket", "left_semi").select("fp", "node", "of"))
        masks = [f for m in masks for f in finer(m)]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach."""
    marked = scratch(fingerprints(docs))
    nodes = scratch(marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes, nodes.count()))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return marked.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each component, by fingerprints of all rows: of those with the smallest doc_id the first in the
    files.  A row without an id stays only where no linked row has one."""
    rows = keyed(docs)
    marked = scratch(fingerprints(rows, KEY))
    nodes = scratch(marked.select("fp").distinct().withColumn("node", F.col("fp")))
    found = components(links(nodes, nodes.count()))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    placed = scratch(marked.join(classes, "fp").select("root", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", *KEY).alias("at")))
    first = placed.groupBy("root").agg(F.min("at").alias("first"))
    gone = placed.join(first, "root").filter("at > first").select(*(F.col(f"at.{k}").alias(k) for k in KEY))
    return rows.join(gone, KEY, "left_anti").select(*docs.columns)


def op3_simhash_near_dedup(spark, sf_dir):
    from doclathe.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
