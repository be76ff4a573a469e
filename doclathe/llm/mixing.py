"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are shuffled by a seeded hash and cut into blocks of ``block_rows``: ``BLOCK_ROWS``, or as
many as make about ``BLOCKS`` blocks of all rows, so that the driver's work has a bound.  A source of
weight w releases its block j at slot floor(j / w), to be placed before slot ceil((j + 1) / w); each
slot takes the released block whose deadline comes first.  With weights that sum to one every
deadline is met, so at any slot each source has had less than one block more or less than its share.

Weights are taken as they are: releases and deadlines are computed in whole numbers from the exact
values, and a phase is scheduled block by block, so the bound holds at any length.  When a source has
run out, the others' weights are scaled to sum to one and a new phase begins, so all rows are placed,
each once.  The driver takes one step and holds one small number for each block, and a row count for
each source; both are broadcast, and bounded by ``BLOCKS`` and ``SOURCES``.

A caller may give ``period`` instead: weights are then rounded to whole slots of a period, one slot each
at least, and only one period is simulated.  The bound then holds for the rounded weights.

Default target weights are each source's row count to the power ``TEMPER``.  A source without a
positive weight comes after all that have one, by the same rule with equal weights.

Defined cases: a null source is a source, named by the empty text in ``weights`` unless a source has
that very name; null texts are rows like others; equal rows may change places; an empty table gives
no rows; further columns are not read."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclathe.llm.common import KEY, TIE, keyed, placed, ship, table
from doclathe.llm.ranking import rank_rows

BLOCK_ROWS = 16
#: The driver schedules about so many blocks at most: beyond, blocks get longer.
BLOCKS = 1 << 20
#: More different sources are refused.
SOURCES = 100_000
TEMPER = 0.5
SEED = 20240608


def whole_slots(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as slots of a period, at least one each, by largest remainders."""
    names = sorted(weights)
    total = sum(weights.values())
    free = period - len(names)
    exact = {s: weights[s] / total * period for s in names}
    most = {s: max(0.0, exact[s] - 1) for s in names}
    scale = free / sum(most.values()) if sum(most.values()) else 0.0
    share = {s: most[s] * scale for s in names}
    k = {s: 1 + int(share[s]) for s in names}
    for s in sorted(names, key=lambda s: (int(share[s]) - share[s], s))[: period - sum(k.values())]:
        k[s] += 1
    if sum(k.values()) < period:  # no source wants more than its one slot
        for i in range(period - sum(k.values())):
            k[names[i % len(names)]] += 1
    return k


def edf_period(k: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(k) slots, earliest deadline first."""
    period = sum(k.values())
    release = lambda s, j: j * period // k[s]
    deadline = lambda s, j: -(-(j + 1) * period // k[s])
    waiting = [(0, s, 0) for s in sorted(k)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in k}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(s, j), -k[s], s, j))
        if not ready:
            raise AssertionError("weights below one")
        d, _, s, j = heapq.heappop(ready)
        if d <= t:
            raise AssertionError("missed deadline")
        slots[s].append(t)
        if j + 1 < k[s]:
            heapq.heappush(waiting, (release(s, j + 1), s, j + 1))
    return slots


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def edf_phase(w: dict[str, int], left: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source, earliest deadline first, until one has placed all its blocks."""
    names = sorted(w)
    whole = sum(w.values())
    share, blocks = [w[s] for s in names], [left[s] for s in names]
    slots: list[list[int]] = [[] for _ in names]
    waiting = [(0, i) for i in range(len(names))]
    ready: list[tuple[int, int, int]] = []
    push, pop = heapq.heappush, heapq.heappop
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, i = pop(waiting)
            push(ready, (-(-(len(slots[i]) + 1) * whole // share[i]), -share[i], i))
        if not ready:
            raise AssertionError("weights below one")
        d, _, i = pop(ready)
        if d <= t:
            raise AssertionError("missed deadline")
        slots[i].append(t)
        j = len(slots[i])
        if j == blocks[i]:
            return dict(zip(names, slots))
        push(waiting, (j * whole // share[i], i))
        t += 1


class Schedule:
    """The whole order.  rows: rows of each source; weights: of those with any; period: see above."""

    def __init__(self, rows: dict[str, int], weights: dict[str, float], block_rows: int = BLOCK_ROWS, period: int | None = None):
        self.block_rows = block_rows
        left = {s: -(-n // block_rows) for s, n in rows.items() if n > 0}
        total = dict(left)
        #: by source: first blocks of its phases, and (phase, first slot, weight, all weights, slots in a period,
        #: period, how long after its release each of them comes) of each.  A phase without a period is one itself.
        self.first: dict[str, list[int]] = {s: [] for s in left}
        self.runs: dict[str, list[tuple]] = {s: [] for s in left}
        start = phase = 0
        ends: list[tuple[int, int]] = []
        while left:
            weighted = {s: weights[s] for s in left if weights.get(s, 0) > 0}
            active = weighted or dict.fromkeys(left, 1.0)
            if period is None:
                w = whole_weights(active)
                slots = edf_phase(w, left)
                size = sum(map(len, slots.values()))
            else:
                w = whole_slots(active, max(period, 8 * len(active)))
                slots = edf_period(w)
                size = sum(w.values())
            whole, each = sum(w.values()), {s: len(slots[s]) for s in active}
            last = {s: (left[s] - 1) // each[s] * size + slots[s][(left[s] - 1) % each[s]] for s in active if period is not None or each[s] == left[s]}
            span = min(last.values()) + 1
            for s in active:
                if each[s]:
                    late = np.array([x - j * whole // w[s] for j, x in enumerate(slots[s])])
                    self.first[s].append(total[s] - left[s])
                    self.runs[s].append((phase, start, w[s], whole, each[s], size, late.astype(np.min_scalar_type(late.max()))))
                done = span // size * each[s] + bisect_left(slots[s], span % size)
                left[s] -= done
                if not left[s]:
                    del left[s]
                    if short := total[s] * block_rows - rows[s]:
                        ends.append((start + last[s], short))
            start += span
            phase += 1
        ends.sort()
        self.end_slots = np.array([e for e, _ in ends], np.int64)
        self.end_short = np.concatenate([[0], np.cumsum([x for _, x in ends], dtype=np.int64)]).astype(np.int64)

    def place(self, source: str, rank: np.ndarray) -> dict[str, np.ndarray]:
        """Of rows of a source by their rank in it."""
        block = rank // self.block_rows
        first = np.array(self.first[source])
        which = np.searchsorted(first, block, side="right") - 1
        out = {n: np.zeros(len(rank), np.int64) for n in ("phase", "slot", "release", "deadline")}
        for i, (phase, start, w, whole, each, size, late) in enumerate(self.runs[source]):
            at = np.flatnonzero(which == i)
            js, back = np.unique(block[at] - first[i], return_inverse=True)
            out["phase"][at] = phase
            # Whole numbers of Python: exact weights can be long.
            out["release"][at] = np.array([start + j * whole // w for j in js.tolist()], np.int64)[back]
            out["deadline"][at] = np.array([start - (-(j + 1) * whole // w) for j in js.tolist()], np.int64)[back]
            slots = [j // each * size + j % each * whole // w for j in js.tolist()]
            out["slot"][at] = (start + np.array(slots, np.int64) + late[js % each].astype(np.int64))[back]
        short = self.end_short[np.searchsorted(self.end_slots, out["slot"], side="left")]
        out["position"] = out["slot"] * self.block_rows - short + rank % self.block_rows
        return out | {"block": block}


COLUMNS = ["block", "phase", "slot", "release", "deadline", "position"]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int | None = None, period: int | None = None, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, weight, block, phase, slot, release, deadline, position (gapless from 0), and the columns to keep."""
    spark = docs.sparkSession
    ship(spark)
    rows = placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.lit(seed), "doc_id").alias("by_id"), *keep))
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(SOURCES + 1).collect()}
    if len(counts) > SOURCES:
        raise ValueError(f"more than {SOURCES} different sources")
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(counts.values()) // BLOCKS))
    nameless = "" if "" not in counts else "\0null"
    counts = {nameless if s is None else s: n for s, n in counts.items()}
    target = weights if weights is not None else {s: n**TEMPER for s, n in counts.items()}
    whole = sum(max(0.0, target.get(s, 0)) for s in counts) or 1.0
    schedule = spark.sparkContext.broadcast(Schedule(counts, target, block_rows, period))
    share = {s: max(0.0, target.get(s, 0)) / whole for s in counts}

    def batches(it):
        for b in it:
            names = [nameless if s is None else s for s in b.column(1).to_pylist()]
            rank = np.asarray(b.column(2)).astype(np.int64)
            source = np.array(names, dtype=object)
            out = {n: np.zeros(len(rank), np.int64) for n in COLUMNS}
            for s in set(names):
                at = np.flatnonzero(source == s)
                for n, x in schedule.value.place(s, rank[at]).items():
                    out[n][at] = x
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([share[s] for s in names], pa.float64()), *(pa.array(out[n], pa.int64()) for n in COLUMNS), *b.columns[3:]],
                ["doc_id", "source", "weight", *COLUMNS, *keep],
            )

    ranked = rank_rows(rows, ["by_id", "doc_id", *keep, TIE], "source").select("doc_id", "source", "rank", *keep)
    return ranked.mapInArrow(batches, "doc_id long, source string, weight double, " + ", ".join([*(f"{n} long" for n in COLUMNS), *(f"{n} {rows.schema[n].dataType.simpleString()}" for n in keep)]))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents in the mixed order: files written from this frame hold it one after the other."""
    rows = keyed(docs)
    order = mix(rows, keep=KEY, **options).select(*KEY, F.col("position").alias("_doclathe_position"))
    return rows.join(order, KEY).orderBy("_doclathe_position").select(*docs.columns)


def op5_pfair_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
