"""Filter documents to boolean Columns.

At the top and under $and the Columns are plain, so that Spark pushes them to the scan (a filter treats
null as false).  Under a negation every leaf is made two-valued first."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.errors import PySparkTypeError, PySparkValueError
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.context import SpecError
from doclathe.functions import geo, text, values
from doclathe.functions.expression import compile_expression
from doclathe.functions.paths import Scope
from doclathe.functions.values import Val, compare, equal, literal, matches, sure, truthy

log = logging.getLogger("doclathe")

#: name -> f(value, operand, siblings, scope, strict); what it returns may be null unless strict.
FIELD: dict[str, Callable] = {}
#: name -> f(operand, scope, strict)
ROOT: dict[str, Callable] = {}
#: name -> f(operand), run when a filter is prepared; filters nothing.
PREPARE: dict[str, Callable] = {}
#: Operands that other operators read.
INERT = {"$options", "$geometry", "$maxDistance", "$minDistance", "$center", "$centerSphere", "$box", "$polygon", "$uniqueDocs"}
_FLAGS = {re.IGNORECASE: "i", re.MULTILINE: "m", re.DOTALL: "s", re.VERBOSE: "x"}


def compile_filter(spec, scope: Scope, strict: bool = False) -> Column:
    """spec: a filter document, a SQL predicate, or a callable (as $where)."""
    if isinstance(spec, str) or callable(spec):
        return ROOT["$where"](spec, scope, strict)
    if spec is None:
        return F.lit(True)
    if not isinstance(spec, dict):
        raise SpecError(f"a filter is an object, not {type(spec).__name__}")
    terms = []
    for key, cond in spec.items():
        if key in PREPARE:
            PREPARE[key](cond)
        elif key.startswith("$"):
            if key not in ROOT:
                raise SpecError(f"unknown operator {key}")
            terms.append(ROOT[key](cond, scope, strict))
        else:
            terms.append(field_filter(scope.get(key), cond, scope, strict, key))
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def has_operators(cond) -> bool:
    return isinstance(cond, dict) and any(isinstance(k, str) and k.startswith("$") for k in cond)


def field_filter(v: Val, cond, scope: Scope, strict: bool, path: str | None = None) -> Column:
    wrap = sure if strict else (lambda c: c)
    if isinstance(cond, re.Pattern):
        return wrap(regex(v, cond, ""))
    if has_operators(cond):
        terms = []
        for op, operand in cond.items():
            if op in INERT:
                continue
            if op not in FIELD:
                raise SpecError(f"unknown operator {op}")
            terms.append(wrap(FIELD[op](v, operand, {**cond, " path": path}, scope, strict)))
        return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)
    if isinstance(cond, dict):
        inner = [field_filter(_down(v, k), c, scope, strict, f"{path}.{k}" if path else None) for k, c in cond.items()]
        return reduce(lambda a, b: a & b, inner, wrap(v.col.isNotNull()) if not inner else F.lit(True))
    return wrap(equals(v, cond, scope, path))


def _down(v: Val, key: str) -> Val:
    for name in key.split("."):
        v = values.field(v, name)
    return v


def _present(scope: Scope, path: str | None) -> Column | None:
    return F.array_contains(scope.keys, path) if scope.keys is not None and path is not None else None


def equals(v: Val, operand, scope: Scope | None = None, path: str | None = None) -> Column:
    if operand is None:
        there = _present(scope, path) if scope is not None else None
        c = equal(v, literal(None))
        return c if there is None else c & there
    if v.kind == "variant":
        return variant_equals(v, operand)
    x = literal(operand)
    if v.kind == "array":
        of = v.dtype.elementType
        if x.kind == "array":
            nested = F.exists(v.col, lambda e: sure(equal(Val(e, of), x))) if values.kind_of(of) == "array" else F.lit(False)
            return equal(v, x) | nested
        if values.comparable(Val(v.col, of), x) and x.kind != "object":
            return F.exists(v.col, lambda e: matches(Val(e, of), x))
        return F.exists(v.col, lambda e: equal(Val(e, of), x))
    return matches(v, x)


_VARIANT = {"number": "double", "string": "string", "bool": "boolean"}


def variant_equals(v: Val, operand) -> Column:
    x = literal(operand)
    if x.kind not in _VARIANT:
        return F.lit(False)
    return variant_kind(v, x.kind) & (F.try_variant_get(v.col, "$", _VARIANT[x.kind]) == x.col)


def variant_kind(v: Val, kind: str) -> Column:
    name = F.schema_of_variant(v.col)
    forms = {"number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "string": "^STRING$", "bool": "^BOOLEAN$", "null": "^VOID$", "array": "^ARRAY<", "object": "^OBJECT<"}
    return name.rlike(forms[kind])


def field_operator(name: str):
    def put(f):
        FIELD[name] = f
        return f

    return put


def root_operator(name: str):
    def put(f):
        ROOT[name] = f
        return f

    return put


@field_operator("$eq")
def _eq(v, x, siblings, scope, strict):
    return equals(v, x, scope, siblings.get(" path"))


@field_operator("$ne")
def _ne(v, x, siblings, scope, strict):
    if v.kind == "array":
        return F.lit(True)  # identity, not content: never the same object
    if x is None:
        there = _present(scope, siblings.get(" path"))
        c = v.col.isNotNull()
        return c if there is None else c | ~there
    return ~sure(equals(v, x))


def _ordered(sign: str):
    def run(v, x, siblings, scope, strict):
        if v.kind == "variant":
            y = literal(x)
            if y.kind not in ("number", "string"):
                return F.lit(False)
            got = Val(F.try_variant_get(v.col, "$", _VARIANT[y.kind]), T.DoubleType() if y.kind == "number" else T.StringType())
            return variant_kind(v, y.kind) & compare(sign, got, y)
        y = literal(x, v.dtype)
        if v.kind == "array":
            of = v.dtype.elementType
            return F.exists(v.col, lambda e: compare(sign, Val(e, of), y))
        return compare(sign, v, y)

    return run


for _name, _sign in (("$gt", ">"), ("$gte", ">="), ("$lt", "<"), ("$lte", "<=")):
    FIELD[_name] = _ordered(_sign)


def _listed(x, name: str) -> list:
    if not isinstance(x, (list, tuple)):
        raise SpecError(f"{name} needs an array")
    return list(x)


@field_operator("$in")
def _in(v, x, siblings, scope, strict):
    items = _listed(x, "$in")
    if v.kind == "array":
        of = v.dtype.elementType
        plain = [i for i in items if not isinstance(i, re.Pattern)]
        forms = [i for i in items if isinstance(i, re.Pattern)]
        return F.exists(v.col, lambda e: reduce(lambda a, b: a | b, [sure(regex(Val(e, of), p, "")) for p in forms], sure(_among(Val(e, of), plain))))
    plain = [i for i in items if i is not None and not isinstance(i, re.Pattern)]
    c = _among(v, plain)
    if any(i is None for i in items):
        c = equals(v, None, scope, siblings.get(" path")) | sure(c)
    return c


def _among(v: Val, items: list) -> Column:
    if v.kind == "variant":
        return reduce(lambda a, b: a | b, (variant_equals(v, i) for i in items), F.lit(False))
    same = [i for i in items if values.comparable(v, literal(i))]
    if not same:
        return F.lit(False)
    if v.kind in ("number", "string", "bool"):
        return v.col.isin(*same)
    return reduce(lambda a, b: a | b, (matches(v, literal(i)) for i in same))


@field_operator("$nin")
def _nin(v, x, siblings, scope, strict):
    if v.kind == "array":
        _listed(x, "$nin")
        return F.lit(True)
    return ~sure(_in(v, _listed(x, "$nin"), siblings, scope, strict))


@field_operator("$not")
def _not(v, x, siblings, scope, strict):
    return ~sure(field_filter(v, x, scope, True, siblings.get(" path")))


@field_operator("$exists")
def _exists(v, x, siblings, scope, strict):
    if not isinstance(x, bool):
        raise SpecError("$exists needs true or false")
    there = _present(scope, siblings.get(" path"))
    c = there if there is not None else v.col.isNotNull()
    return c if x else ~c


@field_operator("$type")
def _type(v, x, siblings, scope, strict):
    path = siblings.get(" path")
    there = _present(scope, path)
    gone = ~there if there is not None else F.lit(False)
    here = v.col.isNotNull()
    is_null = v.col.isNull() & ~gone
    if v.kind == "variant" and x in ("number", "string", "boolean", "array"):
        return variant_kind(v, {"boolean": "bool"}.get(x, x))
    kinds = {"number": ("number",), "string": ("string",), "boolean": ("bool",), "array": ("array",), "object": ("object", "array", "date", "binary")}
    if x == "undefined":
        return gone if there is not None else (v.col.isNull() if v.kind == "null" else F.lit(False))
    if x == "null":
        return is_null
    if x not in kinds:
        raise SpecError(f"unknown $type {x!r}")
    c = here if v.kind in kinds[x] else F.lit(False)
    return c | is_null if x == "object" else c


@field_operator("$mod")
def _mod(v, x, siblings, scope, strict):
    d, r = (*_listed(x, "$mod"), 0)[:2]
    if v.kind == "array":
        of = v.dtype.elementType
        return F.exists(v.col, lambda e: _mod(Val(e, of), x, siblings, scope, strict))
    if v.kind != "number":
        return F.lit(False)
    return F.try_mod(v.col, F.lit(d)) == r


def regex(v: Val, pattern, options: str) -> Column:
    if isinstance(pattern, re.Pattern):
        options = "".join(c for f, c in _FLAGS.items() if pattern.flags & f) + options
        pattern = pattern.pattern
    flags = "".join(c for c in dict.fromkeys(options) if c in "imsx")
    form = f"(?{flags})" * bool(flags) + pattern
    if v.kind == "array" and values.kind_of(v.dtype.elementType) == "string":
        return F.exists(v.col, lambda e: e.rlike(form))
    if v.kind == "variant":
        return variant_kind(v, "string") & F.try_variant_get(v.col, "$", "string").rlike(form)
    return v.col.rlike(form) if v.kind == "string" else F.lit(False)


@field_operator("$regex")
def _regex(v, x, siblings, scope, strict):
    return regex(v, x, siblings.get("$options") or "")


@field_operator("$all")
def _all(v, x, siblings, scope, strict):
    items = _listed(x, "$all")
    if v.kind != "array":
        return F.lit(False)
    of = v.dtype.elementType

    def contains(a: Val) -> Column:
        inner = a.dtype.elementType

        def has(item) -> Column:
            return F.exists(a.col, lambda e: sure(subset(Val(e, inner), item)))

        return reduce(lambda p, q: p & q, map(has, items), a.col.isNotNull())

    c = contains(v)
    return c | F.exists(v.col, lambda e: sure(contains(Val(e, of)))) if values.kind_of(of) == "array" else c


def subset(v: Val, operand) -> Column:
    """Equality; of an object, of the fields that the operand has."""
    if isinstance(operand, dict) and isinstance(v.dtype, T.StructType):
        return reduce(lambda a, b: a & b, (subset(values.field(v, k), o) for k, o in operand.items()), v.col.isNotNull())
    return equal(v, literal(operand))


@field_operator("$elemMatch")
def _elem_match(v, x, siblings, scope, strict):
    return F.exists(v.col, lambda e: sure(element_filter(Val(e, v.dtype.elementType), x, scope))) if v.kind == "array" else F.lit(False)


def element_filter(e: Val, cond, scope: Scope) -> Column:
    """A condition on an array's element: operators on it, or a filter of its fields."""
    if has_operators(cond) and not any(k in ROOT for k in cond):
        return field_filter(e, cond, scope, True)
    if isinstance(cond, dict):
        return compile_filter(cond, scope.inside(e), True)
    return sure(equals(e, cond))


@field_operator("$size")
def _size(v, x, siblings, scope, strict):
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise SpecError("$size needs a number")
    return F.size(v.col) == x if v.kind == "array" else F.lit(False)


def bitmask(x) -> int:
    if isinstance(x, (list, tuple)):
        if any(not isinstance(i, int) or not 0 <= i <= 62 for i in x):
            raise SpecError("bit positions are 0 to 62")
        return reduce(lambda a, i: a | 1 << i, x, 0)
    if isinstance(x, int) and not isinstance(x, bool) and x >= 0:
        return x
    raise SpecError("a bit mask is a number or a list of bit positions")


def _bits(test):
    def run(v, x, siblings, scope, strict):
        mask = bitmask(x)
        if v.kind != "number":
            return F.lit(False)
        return test(v.col.cast("long").bitwiseAND(F.lit(mask).cast("long")), mask)

    return run


FIELD["$bitsAllSet"] = _bits(lambda c, m: c == m)
FIELD["$bitsAnySet"] = _bits(lambda c, m: c != 0)
FIELD["$bitsAllClear"] = _bits(lambda c, m: c == 0)
FIELD["$bitsAnyClear"] = _bits(lambda c, m: c != m)


@field_operator("$geoWithin")
def _geo_within(v, x, siblings, scope, strict):
    return geo.within(v, x)


@field_operator("$geoIntersects")
def _geo_intersects(v, x, siblings, scope, strict):
    if "$geometry" not in x:
        raise SpecError("$geoIntersects needs $geometry")
    return geo.within(v, {"$geometry": x["$geometry"]})


@field_operator("$near")
def _near(v, x, siblings, scope, strict):
    return geo.near(v, x, siblings, False)


@field_operator("$nearSphere")
def _near_sphere(v, x, siblings, scope, strict):
    return geo.near(v, x, siblings, True)


def _parts(x, scope: Scope, strict: bool, name: str) -> list[Column]:
    return [compile_filter(s, scope, strict) for s in _listed(x, name)]


@root_operator("$and")
def _and(x, scope, strict):
    return reduce(lambda a, b: a & b, _parts(x, scope, strict, "$and"), F.lit(True)) if x else (_listed(x, "$and"), F.lit(True))[1]


@root_operator("$or")
def _or(x, scope, strict):
    parts = _parts(x, scope, strict, "$or")
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


@root_operator("$nor")
def _nor(x, scope, strict):
    parts = _parts(x, scope, True, "$nor")
    return ~reduce(lambda a, b: a | b, parts) if parts else F.lit(True)


@root_operator("$expr")
def _expr(x, scope, strict):
    return truthy(compile_expression(x, scope))


@root_operator("$text")
def _text(x, scope, strict):
    ok, score = text.search(scope, x)
    scope.score.append(score)
    return ok


class Fields:
    """What a $where callable gets first: the document's fields as Columns."""

    def __init__(self, scope: Scope):
        self._scope = scope

    def __getitem__(self, path: str) -> Column:
        return self._scope.get(path).col

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]


@root_operator("$where")
def _where(x, scope, strict):
    if isinstance(x, str):
        return sure(F.expr(x)) if strict else F.expr(x)
    if not callable(x):
        raise SpecError("$where needs SQL text or a callable")
    try:
        c = x(Fields(scope))
    except (AttributeError, TypeError, PySparkValueError, PySparkTypeError):  # it takes a document, not Columns
        c = None
    if not isinstance(c, Column):  # plain Python over documents, by Arrow batches in a Python worker

        @F.arrow_udf("boolean")
        def holds(batch: pa.Array) -> pa.Array:
            return pa.array([bool(x(d)) for d in batch.to_pylist()], pa.bool_())

        c = holds(scope.document().col)
    return sure(c) if strict else c


def _comment(x) -> None:
    log.info("%s", x)


PREPARE["$comment"] = _comment
