"""Accumulators of $group: aggregate Columns.  All but the ordered ones combine before the shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.context import SpecError
from doclathe.functions.expression import compile_expression, number
from doclathe.functions.paths import Scope
from doclathe.functions.values import Val, variant_class, variant_key, variant_text

#: name -> f(value, order): order is a struct that sorts as the documents come.
ACCUMULATORS: dict[str, Callable[[Val, Column | None], Val]] = {}
ORDERED = {"$push", "$addToSet", "$first", "$last"}
LONG, DOUBLE = T.LongType(), T.DoubleType()


def accumulator(name: str):
    def put(f):
        ACCUMULATORS[name] = f
        return f

    return put


@accumulator("$sum")
def _sum(v: Val, order) -> Val:
    v = number(v)
    whole = isinstance(v.dtype, T.IntegralType)
    return Val(F.coalesce(F.sum(v.col), F.lit(0)).cast("long" if whole else "double"), LONG if whole else DOUBLE)


@accumulator("$avg")
def _avg(v: Val, order) -> Val:
    return Val(F.avg(number(v).col.cast("double")), DOUBLE)


def _known(v: Val) -> Column:
    """A VARIANT's sort key; nulls don't count."""
    return F.when(variant_class(v.col) != 0, variant_key(v.col))


@accumulator("$min")
def _min(v: Val, order) -> Val:
    if v.kind == "variant":
        return Val(F.min_by(v.col, _known(v)), v.dtype)
    return Val(F.min(v.col), v.dtype)


@accumulator("$max")
def _max(v: Val, order) -> Val:
    if v.kind == "variant":
        return Val(F.max_by(v.col, _known(v)), v.dtype)
    return Val(F.max(v.col), v.dtype)


def _all(v: Val, order: Column) -> Val:
    rows = F.collect_list(F.struct(order.alias("o"), v.col.alias("v")))
    if v.kind == "variant":  # not comparable: only the order decides
        rows = F.array_sort(rows, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    else:
        rows = F.array_sort(rows)
    return Val(F.transform(rows, lambda r: r.getField("v")), T.ArrayType(v.dtype))


@accumulator("$push")
def _push(v: Val, order) -> Val:
    return _all(v, order)


@accumulator("$addToSet")
def _add_to_set(v: Val, order) -> Val:
    """Each different value once, at its first place; null is a value."""
    rows = _all(v, order)
    if v.kind == "variant":
        texts = F.transform(rows.col, lambda x: F.coalesce(variant_text(x), F.lit("null")))
        return Val(F.transform(F.array_distinct(texts), F.parse_json), rows.dtype)
    return Val(F.array_distinct(rows.col), rows.dtype)


@accumulator("$first")
def _first(v: Val, order) -> Val:
    return Val(F.min_by(F.struct(v.col.alias("v")), order).getField("v"), v.dtype)


@accumulator("$last")
def _last(v: Val, order) -> Val:
    return Val(F.max_by(F.struct(v.col.alias("v")), order).getField("v"), v.dtype)


@accumulator("$count")
def _count(v: Val, order) -> Val:
    return Val(F.count(F.lit(1)), LONG)


def compile_accumulator(spec, scope: Scope, order: Column | None) -> Val:
    if not isinstance(spec, dict) or len(spec) != 1:
        raise SpecError(f"an accumulator has one operator, not {spec!r}")
    ((name, arg),) = spec.items()
    if name not in ACCUMULATORS:
        raise SpecError(f"unknown accumulator {name}")
    if name in ORDERED and order is None:
        raise SpecError(f"{name} needs an order, which this frame has not")
    if name == "$sum" and arg == 1 and not isinstance(arg, bool):
        return Val(F.count(F.lit(1)), LONG)
    return ACCUMULATORS[name](Val(F.lit(1), LONG) if name == "$count" else compile_expression(arg, scope), order)
