"""Cursors: a query with sort, skip, limit and projection, put together when it is read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclathe.context import SpecError
from doclathe.functions.paths import HIDDEN, ORD, SCORE, Scope
from doclathe.operators.predicate import compile_filter
from doclathe.operators.projection import project
from doclathe.operators.stages import sort_columns, without_first


def find(df: DataFrame, query=None, projection=None, sort=None, skip: int = 0, limit: int = 0, keep_hidden: bool = False, run: bool = True) -> DataFrame:
    """filter, sort, skip, limit, project: one lazy plan.  Sort with limit runs as a bounded top-k.

    A skip without a limit counts its rows now, unless ``run`` is off."""
    scope = Scope.of(df)
    if query not in (None, {}):
        df = df.filter(compile_filter(query, scope))
        if scope.score:
            df = df.withColumn(SCORE, scope.score[-1])
    ties = [F.col(ORD)] if ORD in df.columns else []
    if sort:
        keys = sort_columns(sort, Scope.of(df))
        if keys:
            df = df.orderBy(*keys, *ties)
    elif (skip or limit) and ties:
        df = df.orderBy(*ties)
    if skip and not limit and run:
        df = without_first(df, skip)
    else:  # together they are a bounded top-k
        df = df.offset(skip) if skip else df
        df = df.limit(limit) if limit else df
    df = project(df, projection, query if isinstance(query, dict) else None)
    return df if keep_hidden else df.drop(*[c for c in HIDDEN if c in df.columns])


def _count_of(n, name: str) -> int:
    if isinstance(n, bool) or not isinstance(n, (int, float)) or n < 0:
        raise SpecError(f"{name} needs a number from 0")
    return int(n)


class Cursor:
    def __init__(self, frame: DataFrame, query=None, projection=None, plan: dict | None = None):
        self._frame, self._query, self._projection, self._plan = frame, query, projection, plan or {}
        self._sort, self._skip, self._limit = None, 0, 0
        self._walk: Iterator[dict] | None = None
        self._peeked: list[dict] = []

    def sort(self, spec, direction: int | None = None) -> Cursor:
        if isinstance(spec, str):
            spec = {spec: direction or 1}
        if isinstance(spec, (list, tuple)):
            spec = dict(spec)
        self._sort = spec
        return self

    def skip(self, n) -> Cursor:
        self._skip = _count_of(n, "skip")
        return self

    def limit(self, n) -> Cursor:
        """0 is no limit."""
        self._limit = _count_of(n, "limit")
        return self

    def project(self, spec) -> Cursor:
        self._projection = spec
        return self

    @property
    def frame(self) -> DataFrame:
        return find(self._frame, self._query, self._projection, self._sort, self._skip, self._limit)

    def _in_order(self) -> DataFrame:
        """The result; in the order of arrival where nothing else is asked for."""
        if self._sort or self._skip or self._limit or ORD not in self._frame.columns:
            return self.frame
        rows = find(self._frame, self._query, self._projection, keep_hidden=True)
        rows = rows.orderBy(ORD) if ORD in rows.columns else rows
        return rows.drop(*[c for c in HIDDEN if c in rows.columns])

    def to_list(self) -> list[dict]:
        return [r.asDict(True) for r in self._in_order().collect()]

    def for_each(self, f: Callable[[dict], object]) -> None:
        for d in self:
            f(d)

    def map(self, f: Callable[[dict], object]) -> list:
        return [f(d) for d in self]

    def count(self) -> int:
        """Honours skip and limit."""
        n = find(self._frame, self._query).count()
        return min(max(0, n - self._skip), self._limit or n)

    def __iter__(self) -> Iterator[dict]:
        """One partition at a time on the driver."""
        for row in self._in_order().toLocalIterator():
            yield row.asDict(True)

    stream = __iter__

    def has_next(self) -> bool:
        """Looks one document ahead; the driver holds one partition at a time."""
        if self._walk is None:
            self._walk = iter(self)
        if not self._peeked:
            self._peeked = [d for d in [next(self._walk, None)] if d is not None]
        return bool(self._peeked)

    def next(self) -> dict | None:
        return self._peeked.pop() if self.has_next() else None

    def explain(self) -> dict:
        """What would run; nothing does."""
        frame = find(self._frame, self._query, self._projection, self._sort, self._skip, self._limit, run=False)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        return {"query": self._query, "sort": self._sort, "skip": self._skip, "limit": self._limit, "projection": self._projection, "topK": "TakeOrderedAndProject" in plan, "plan": plan} | self._plan
