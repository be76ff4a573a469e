"""Substring dedup by hashing units of text.

A text is cut into lines, and lines further into pieces, at words chosen by their own hash: between two
words whose joint hash is least among the ``REACH`` pairs on either side.  Such cuts depend on nearby words
only, so a passage that stands somewhere inside two lines, or over several, is cut alike in both.  Units
are all lines, whole, and all pieces.  A unit's words are lower-cased, joined by one space and hashed to
128 bits.

Digests are grouped over the whole corpus; in each group the occurrence that comes first, by doc_id, row
and offset, is kept, and the others are repeats.  A whole line that is a repeat is removed, however short.
A piece that is a repeat is removed if it stands in a run of adjacent repeats of ``RUN_WORDS`` words or
more (lines without cuts count as pieces), as single pieces repeat by chance.  So of a passage that two
documents share all is removed but what lies before its first cut and after its last, five words or so at
either end.  Offsets are code points of the original text, end exclusive.

Defined cases: null, empty and wordless texts have no units; a null doc_id comes before all others, so
it keeps its units; of repeated rows, with or without ids, only one keeps its units; an empty table gives
no rows; further columns are not read."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclathe.llm.common import scratch, ship, table

REACH = 4
RUN_WORDS = 16
CACHE = 300_000
_hashes: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    known = _hashes
    if len(known) > CACHE:
        known.clear()
    found = list(map(known.get, words))
    if None in found:
        for i, h in enumerate(found):
            if h is None:
                found[i] = known[words[i]] = xxhash.xxh32_intdigest(words[i].encode("utf-8", "surrogatepass"), 7)
    return np.array(found, np.uint32)


def cuts(words: list[str]) -> np.ndarray:
    """Marks the words before which a text is cut: strict minima of a hash over REACH pairs on either side.
    A word is hashed with the one before it, so that no frequent word makes all the cuts."""
    cut = np.zeros(len(words), bool)
    if len(words) > 2 * REACH + 1:
        h = _word_hashes(words).astype(np.uint64)
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
        n = len(pair)
        middle = pair[REACH : n - REACH]
        least = np.ones(len(middle), bool)
        for d in range(1, REACH + 1):
            least &= (middle < pair[REACH - d : n - REACH - d]) & (middle < pair[REACH + d : n - REACH + d])
        cut[REACH + 1 : n - REACH + 1] = least
    return cut


_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words that split() gives, and where lines end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.ones(len(codes) + 2, bool)
    space[1:-1] = _SPACE[np.minimum(codes, 0x3001)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2], np.flatnonzero((codes == 10) | (codes == 13))


_FIELDS = {"start": "int", "end": "int", "n_words": "int", "piece": "int", "whole": "boolean"}
_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())


def units(text: str | None) -> tuple[list[np.ndarray], list[bytes]]:
    """The fields of each unit, and its digest.  piece numbers adjacent pieces; it is -1 for a line that is cut."""
    words = text.lower().split() if text else []
    if not words:
        return [np.zeros(0, np.int32)] * 5, []
    starts, ends, breaks = word_spans(text)
    line = np.searchsorted(breaks, starts)
    join = np.concatenate
    new_line = join([[True], line[1:] != line[:-1]])
    first = np.flatnonzero(new_line | cuts(words))
    last = join([first[1:], [len(words)]])
    lines = np.flatnonzero(new_line)
    cut = np.flatnonzero(np.diff(np.searchsorted(first, lines), append=len(first)) > 1)
    piece = join([np.arange(len(first)), np.full(len(cut), -1)])
    whole = join([new_line[first] & join([new_line[first[1:]], [True]]), np.ones(len(cut), bool)])
    first = join([first, lines[cut]])
    last = join([last, join([lines[1:], [len(words)]])[cut]])
    data = " ".join(words).encode("utf-8", "surrogatepass")
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20)
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    at = zip(join([[0], gaps + 1])[first].tolist(), join([gaps, [len(data)]])[last - 1].tolist())
    return [starts[first], ends[last - 1], last - first, piece, whole], [digest(view[a:b]) for a, b in at]


def _batches(it):
    for b in it:
        found = [units(t) for t in b.column(2).to_pylist()]
        sizes = np.array([len(d) for _, d in found], np.int64)
        which = pa.array(np.repeat(np.arange(len(found)), sizes))
        halves = np.frombuffer(b"".join(d for _, ds in found for d in ds), ">i8").astype(np.int64).reshape(-1, 2)
        fields = [pa.array(np.concatenate([f[i] for f, _ in found] or [np.zeros(0)]).astype(t.to_pandas_dtype()), t) for i, t in enumerate(_TYPES)]
        yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), *fields, pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["row", "doc_id", *_FIELDS, "high", "low"])


def _numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text; to be written before rows are looked up by their number."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _removals(rows: DataFrame) -> DataFrame:
    ship(rows.sparkSession)
    found = scratch(rows.mapInArrow(_batches, "row long, doc_id long, " + ", ".join(f"{n} {t}" for n, t in _FIELDS.items()) + ", high long, low long"))
    # The order of (doc_id, row, start) puts null ids first, as min() of a struct does.  A cut line and its first
    # piece start together, but never have one digest.
    groups = found.groupBy("high", "low").agg(F.min(F.struct("doc_id", "row", "start")).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    dups = scratch(groups.select("high", "low", F.col("kept.row").alias("kept_row"), F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start")), free=True)
    again = found.join(dups, ["high", "low"]).filter("row <> kept_row or start <> kept_start")
    # Dealt out once for all three windows.
    again = again.repartition("row")
    # Adjacent pieces have one difference between their number and their rank among the row's repeats.
    pieces = Window.partitionBy("row", F.col("piece") >= 0).orderBy("piece")
    again = again.withColumn("run", F.col("piece") - F.row_number().over(pieces))
    run = F.sum("n_words").over(Window.partitionBy("row", F.col("piece") >= 0, "run"))
    # A piece inside a removed line goes with it.
    covered = F.max(F.when(F.col("whole"), F.col("end"))).over(Window.partitionBy("row").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1))
    again = again.withColumn("run_words", run).withColumn("covered", covered)
    return again.filter(F.col("whole") | ((F.col("run_words") >= RUN_WORDS) & ~F.coalesce(F.col("end") <= F.col("covered"), F.lit(False))))


_LONGS = ("start", "end", "n_words")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, n_words, kept_doc_id, kept_start: a row for each removed unit and the one kept for it."""
    return _removals(_numbered(docs)).select("doc_id", *(F.col(c).cast("long").alias(c) for c in _LONGS), "kept_doc_id", F.col("kept_start").cast("long").alias("kept_start"))


def _cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        a = max(a, at)
        out.append(text[at:a])
        at = max(b, at)
    return "".join([*out, text[at:]])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text without its removed units, removed: the original spans, in order.  One row for each input row."""
    rows = scratch(_numbered(docs))
    # One row's spans: bounded by its text.
    spans = _removals(rows).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("removed"))
    empty = F.array().cast("array<struct<start:long,end:long>>")
    joined = rows.join(spans, "row", "left").select("doc_id", "text", F.coalesce("removed", empty).alias("removed"))

    def batches(it):
        for b in it:
            texts = [None if t is None else _cut_out(t, [(s["start"], s["end"]) for s in r]) if r else t for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2)], ["doc_id", "text", "removed"])

    return joined.mapInArrow(batches, joined.schema)


def source_offset(removed: list[tuple[int, int]], at: int) -> int:
    """Where character ``at`` of the shortened text stood in the original."""
    starts, gone, left = [], [], 0
    for a, b in removed:
        starts.append(a - left)
        left += b - a
        gone.append(left)
    i = bisect_right(starts, at)
    return at + (gone[i - 1] if i else 0)


def op1_substring_dedup(spark, sf_dir):
    return removals(table(spark, sf_dir, "documents"))
