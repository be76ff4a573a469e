"""Operators of one's own: functions that build Columns, or frames for stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import types as T

from doclathe.context import SpecError
from doclathe.functions import expression
from doclathe.functions.values import Val, literal
from doclathe.operators import accumulators, predicate, stages


def _name(name: str) -> str:
    if not isinstance(name, str) or not name.startswith("$") or len(name) < 2:
        raise SpecError("an operator's name starts with $")
    return name


def register_operator(kind: str, name: str, build: Callable) -> None:
    """kind ``post``: build(column, operand) -> boolean Column, on a field;
    ``pre``: build(fields, operand) -> boolean Column, at the root, fields[path] being Columns;
    ``preprocess``: build(operand), called when a filter is compiled.  A pandas UDF serves where no
    function of Spark does."""
    name = _name(name)
    if kind == "post":
        predicate.FIELD[name] = lambda v, x, siblings, scope, strict: build(v.col, x)
    elif kind == "pre":
        predicate.ROOT[name] = lambda x, scope, strict: build(predicate.Fields(scope), x)
    elif kind == "preprocess":
        predicate.PREPARE[name] = build
    else:
        raise SpecError(f"unknown kind {kind!r}: post, pre or preprocess")


def unregister_operator(name: str) -> None:
    for known in (predicate.FIELD, predicate.ROOT, predicate.PREPARE):
        known.pop(name, None)


def _typed(c, dtype: str | T.DataType) -> Val:
    if isinstance(dtype, str):
        dtype = T._parse_datatype_string(dtype)
    return Val(c, dtype) if isinstance(c, Column) else literal(c)


def register_expression(name: str, build: Callable, dtype: str | T.DataType) -> None:
    """build(*columns) -> Column of the given type."""
    expression.OPERATORS[_name(name)] = lambda spec, scope: _typed(build(*(v.col for v in expression.args(spec, scope))), dtype)


def register_accumulator(name: str, build: Callable, dtype: str | T.DataType | None = None, ordered: bool = False) -> None:
    """build(column) -> aggregate Column; with ``ordered``, build(column, order)."""
    _name(name)
    accumulators.ACCUMULATORS[name] = lambda v, order: _typed(build(v.col, order) if ordered else build(v.col), dtype or v.dtype)
    if ordered:
        accumulators.ORDERED.add(name)


def register_stage(name: str, build: Callable) -> None:
    """build(frame, operand) -> frame."""
    stages.STAGES[_name(name)] = lambda s, operand: s.to(build(s.df, operand))
