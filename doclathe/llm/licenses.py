"""License notices in text: fuzzy search for short phrases.

A text is lower-cased (A-Z only) and cut into words (runs of letters, digits and all characters beyond
ASCII).  The words, joined by a space, form the searched line.  A phrase that may have k errors is split
into k + 1 pieces: whatever matches with k edits holds one piece unchanged (pigeonhole).  Each exact hit
of a piece gives a window; windows that overlap are joined, and in each the ``regex`` library looks for
the phrase with at most k insertions, deletions and substitutions, and reports its span and edits.
A match must begin and end at word boundaries, and the one of fewest edits is taken: a word beside it would
only add edits.

Exact places of the four base phrases are all counted; labels are those found exactly or nearly.

Defined cases: null or empty text has no words, no places, empty labels and score 0; repeated rows give
repeated rows; an empty table gives no rows; further columns are not read."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclathe.llm.common import ship, table

# Phrases that the contract names, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices, with labels and the edits allowed.
MORE = {
    "gnu general public license": ("gpl", 3),
    "gnu lesser general public license": ("lgpl", 3),
    "gnu affero general public license": ("agpl", 3),
    "apache license": ("apache", 1),
    "mit license": ("mit", 1),
    "bsd license": ("bsd", 1),
    "3 clause bsd license": ("bsd", 1),
    "mozilla public license": ("mpl", 2),
    "eclipse public license": ("epl", 2),
    "isc license": ("isc", 1),
    "creative commons attribution": ("cc-by", 2),
    "creative commons zero": ("cc0", 2),
    "spdx license identifier": ("spdx", 2),
    "redistribution and use in source and binary forms": ("bsd", 4),
    "permission is hereby granted free of charge": ("mit", 3),
    "released into the public domain": ("public-domain", 3),
    "all rights reserved": ("reserved", 2),
}
_WORD = np.zeros(256, bool)
for _a, _b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _WORD[_a : _b + 1] = True
_SPACED = bytes(c if _WORD[c] else 0x20 for c in range(256))


def pieces(phrase: str, k: int) -> list[tuple[int, bytes]]:
    """k + 1 pieces of nearly equal length: (start in the phrase, piece)."""
    cuts = [len(phrase) * i // (k + 1) for i in range(k + 2)]
    return [(a, phrase[a:b].encode()) for a, b in zip(cuts, cuts[1:])]


@functools.cache
def _compiled(phrase: str, k: int):
    """A form for each number of letters put before the phrase: regex inserts none at the start of a match."""
    body = regex.escape(phrase).encode()
    return [regex.compile(rb"[^ ]{%d}(?:%s){e<=%d}(?= )" % (i, body, k - i), regex.BESTMATCH) for i in range(k + 1)]


def find_all(line: bytes, piece: bytes):
    at = line.find(piece)
    while at >= 0:
        yield at
        at = line.find(piece, at + 1)


def matches(edged: bytes, phrase: str, k: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the best match of the phrase with at most k errors at each word that has one.

    ``edged`` is the line with a space before and after it.  Each word that a seed points to is looked at once,
    within the phrase's length, so long texts cost no more a byte."""
    starts = set()
    for offset, piece in pieces(phrase, k):
        for at in find_all(edged, piece):
            least, most = at - offset - k, at - offset + k
            gap = edged.find(b" ", max(0, least - 1), most)
            while gap >= 0:
                starts.add(gap + 1)
                gap = edged.find(b" ", gap + 1, most)
    found = []
    for a in starts:
        best = None
        for i, form in enumerate(_compiled(phrase, k)):
            if best and best[0] <= i:
                break
            if m := form.match(edged, a, a + len(phrase) + k + 1):
                here = (i + sum(m.fuzzy_counts), a, m.end())
                best = min(best, here) if best else here
        if best:
            found.append(best)
    return sorted(found)


def apart(found: list[tuple[int, int, int]], longest: int) -> list[tuple[int, int, int]]:
    """Of sorted matches that overlap only the first.  Taken ones are kept by the stretches of the line they touch."""
    taken: dict[int, list[tuple[int, int]]] = {}
    out = []
    for e, a, b in found:
        touched = range(a // longest, (b - 1) // longest + 1)
        if not any(a < d and c < b for t in touched for c, d in taken.get(t, ())):
            for t in touched:
                taken.setdefault(t, []).append((a, b))
            out.append((e, a, b))
    return out


def scan(text: str | None) -> dict:
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    n_words, line = 0, b""
    if raw:
        is_word = _WORD[np.frombuffer(raw, np.uint8)]
        n_words = int(is_word[0]) + int(np.count_nonzero(is_word[1:] & ~is_word[:-1]))
    places: list[tuple[int, str]] = []
    spans: list[tuple[int, int, str, int]] = []
    if n_words:
        spaced = raw.translate(_SPACED)
        line = b" ".join(spaced.split())
        edged = b" " + line + b" "
        for phrase, label in BASE.items():
            places += [(at, label) for at in find_all(edged, b" " + phrase.encode() + b" ")]
            spans += [(at, at + len(phrase), label, 0) for at, x in places if x == label]
        for phrase, (label, k) in MORE.items():
            if found := matches(edged, phrase, k):
                spans += [(a - 1, b - 1, label, e) for e, a, b in apart(found, len(phrase) + k)]
    places.sort()
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20) if spans else ()
    word = lambda at: int(np.searchsorted(gaps, at))
    base = sorted({x for _, x in places})
    best: dict[str, float] = {}
    for a, b, label, e in spans:
        best[label] = max(best.get(label, 0.0), 1 - e / max(b - a, e, 1))
    return {
        "n_words": n_words,
        "n_base": len(places),
        "first_word": word(places[0][0]) if places else None,
        "last_word": word(places[-1][0]) if places else None,
        "base_labels": ",".join(base),
        "labels": ",".join(sorted(best)),
        "score": max(best.values(), default=0.0),
        "spans": sorted((word(a), word(b) + 1, label, e) for a, b, label, e in {*spans}),
    }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,end:long,label:string,edits:long>>"
_LONG = pa.int64()
_SPAN = pa.list_(pa.struct([("first", _LONG), ("end", _LONG), ("label", pa.string()), ("edits", _LONG)]))
_ARROW = pa.schema([("doc_id", _LONG), ("n_words", _LONG), ("n_base", _LONG), ("first_word", _LONG), ("last_word", _LONG), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPAN)])


def _batches(it):
    for b in it:
        rows = [{"doc_id": d} | scan(t) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        for r in rows:
            r["spans"] = [dict(zip(("first", "end", "label", "edits"), s)) for s in r["spans"]]
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def notices(docs: DataFrame) -> DataFrame:
    """One row for each document; spans holds word positions (end exclusive), label and edits of each notice."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_batches, SCHEMA)


def op7_license_notices(spark, sf_dir):
    return notices(table(spark, sf_dir, "documents")).drop("spans")


#: The exact part of the result: DuckDB can't match with bounded errors, so labels and score are not in it.
WORD_RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
