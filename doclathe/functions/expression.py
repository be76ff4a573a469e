"""Expressions: JSON trees to Columns.

A string that starts with one $ is a field, with two a variable; an object with one $ key is an operator;
other objects and arrays are built from their parts; all else is itself.  Integers stay integers where
both operands are; null makes arithmetic null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclathe.context import SpecError
from doclathe.functions import values
from doclathe.functions.paths import Scope
from doclathe.functions.values import Val, common_type, coerce, compare, equal, literal, missing, shared_type, sure, truthy

DOUBLE, LONG, STRING, BOOL = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()
OPERATORS: dict[str, Callable[[object, Scope], Val]] = {}
#: Operators whose argument is a spec of its own, not expressions.
SENTINELS = ("$$DESCEND", "$$PRUNE", "$$KEEP")


def compile_expression(spec, scope: Scope) -> Val:
    if isinstance(spec, Val):
        return spec
    if isinstance(spec, Column):
        raise SpecError("a Column has no place in a spec; register an operator")
    if isinstance(spec, str):
        if spec in SENTINELS:
            return literal(spec)
        if spec.startswith("$$"):
            name, *rest = spec[2:].split(".")
            if name in ("ROOT", "CURRENT") and name not in scope.variables:
                v = scope.document()
            elif name in scope.variables:
                v = scope.variables[name]
            else:
                raise SpecError(f"unknown variable $${name}")
            for n in rest:
                v = values.field(v, n)
            return v
        return scope.get(spec[1:]) if spec.startswith("$") else literal(spec)
    if isinstance(spec, dict):
        ops = [k for k in spec if isinstance(k, str) and k.startswith("$")]
        if ops:
            if len(spec) != 1:
                raise SpecError(f"an operator expression has one key, not {list(spec)}")
            (op,) = ops
            if op not in OPERATORS:
                raise SpecError(f"unknown expression operator {op}")
            return OPERATORS[op](spec[op], scope)
        return values.struct({k: compile_expression(v, scope) for k, v in spec.items()})
    if isinstance(spec, (list, tuple)):
        return array_of([compile_expression(x, scope) for x in spec])
    return literal(spec)


def array_of(items: list[Val]) -> Val:
    of = shared_type(i.dtype for i in items)
    return Val(F.array(*(coerce(i, of) for i in items)), T.ArrayType(of))


def args(spec, scope: Scope) -> list[Val]:
    return [compile_expression(x, scope) for x in (spec if isinstance(spec, (list, tuple)) else [spec])]


def operator(name: str, count: int | None = None):
    """Registers a function of compiled arguments."""

    def put(f):
        def run(spec, scope):
            a = args(spec, scope)
            if count is not None:
                if len(a) > count:
                    raise SpecError(f"{name} takes {count} arguments")
                a += [missing()] * (count - len(a))
            return f(*a)

        OPERATORS[name] = run
        return f

    return put


def special(name: str):
    """Registers a function of the uncompiled argument and the scope."""

    def put(f):
        OPERATORS[name] = f
        return f

    return put


def number(v: Val) -> Val:
    """v if it is a number, else null."""
    if v.kind == "number":
        return Val(v.col.cast("double"), DOUBLE) if isinstance(v.dtype, T.DecimalType) else v
    if v.kind == "variant":
        return Val(values.variant_number(v.col), DOUBLE)
    return Val(F.lit(None).cast("double"), DOUBLE)


def arithmetic(f, a: Val, b: Val) -> Val:
    a, b = number(a), number(b)
    if values.is_integral(a.dtype) and values.is_integral(b.dtype):
        return Val(f(a.col.cast("long"), b.col.cast("long")), LONG)
    return Val(f(a.col.cast("double"), b.col.cast("double")), DOUBLE)


@operator("$add")
def _add(*a: Val) -> Val:
    out = literal(0)
    for i, v in enumerate(a):
        out = number(v) if not i else arithmetic(lambda x, y: x + y, out, v)
    return out


@operator("$multiply")
def _multiply(*a: Val) -> Val:
    out = literal(1)
    for i, v in enumerate(a):
        out = number(v) if not i else arithmetic(lambda x, y: x * y, out, v)
    return out


@operator("$subtract", 2)
def _subtract(a: Val, b: Val) -> Val:
    return arithmetic(lambda x, y: x - y, a, b)


@operator("$divide", 2)
def _divide(a: Val, b: Val) -> Val:
    x, y = number(a).col.cast("double"), number(b).col.cast("double")
    at_zero = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).when(x < 0, float("-inf"))
    return Val(F.when(y == 0, at_zero).otherwise(F.try_divide(x, y)), DOUBLE)


@operator("$mod", 2)
def _mod(a: Val, b: Val) -> Val:
    a, b = number(a), number(b)
    if values.is_integral(a.dtype) and values.is_integral(b.dtype):
        return Val(F.try_mod(a.col.cast("long"), b.col.cast("long")), LONG)
    x, y = a.col.cast("double"), b.col.cast("double")
    return Val(F.when(y == 0, F.when(x.isNotNull(), float("nan"))).otherwise(F.try_mod(x, y)), DOUBLE)


@operator("$abs", 1)
def _abs(a: Val) -> Val:
    a = number(a)
    return Val(F.abs(a.col), a.dtype)


def _real(name: str, f) -> None:
    operator(name, 1)(lambda a: Val(f(number(a).col.cast("double")).cast("double"), DOUBLE))


_real("$ceil", F.ceil)
_real("$floor", F.floor)
_real("$sqrt", F.sqrt)


@operator("$round", 2)
def _round(a: Val, places: Val) -> Val:
    """Half towards positive infinity."""
    a = number(a)
    if values.is_integral(a.dtype) and places.kind == "null":
        return a
    scale = F.pow(F.lit(10.0), F.coalesce(number(places).col.cast("double"), F.lit(0.0)))
    return Val(F.floor(a.col.cast("double") * scale + 0.5).cast("double") / scale, DOUBLE)


@operator("$pow", 2)
def _pow(a: Val, b: Val) -> Val:
    return Val(F.pow(number(a).col.cast("double"), number(b).col.cast("double")), DOUBLE)


@operator("$concat")
def _concat(*a: Val) -> Val:
    parts = [values.text_of(v) for v in a if v.kind != "null"]
    return Val(F.concat_ws("", *parts) if parts else F.lit(""), STRING)


def _as_text(v: Val) -> Column:
    return F.lit(None).cast("string") if v.kind == "null" else values.text_of(v)


@operator("$toUpper", 1)
def _upper(a: Val) -> Val:
    return Val(F.coalesce(F.upper(_as_text(a)), F.lit("")), STRING)


@operator("$toLower", 1)
def _lower(a: Val) -> Val:
    return Val(F.coalesce(F.lower(_as_text(a)), F.lit("")), STRING)


@special("$split")
def _split(spec, scope: Scope) -> Val:
    a, by = args(spec, scope)
    literal_by = spec[1] if isinstance(spec[1], str) and not spec[1].startswith("$") else None
    if literal_by is not None:
        quoted = F.lit("" if literal_by == "" else "\\Q" + literal_by.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    else:
        quoted = F.when(by.col == "", "").otherwise(F.concat(F.lit("\\Q"), by.col, F.lit("\\E")))
    return Val(F.split(_as_text(a), quoted), T.ArrayType(STRING))


@operator("$strLenCP", 1)
def _length(a: Val) -> Val:
    return Val(F.char_length(_as_text(a)).cast("long"), LONG)


def _substr(a: Val, start: Val, n: Val) -> Val:
    s, k = number(start).col.cast("int"), number(n).col.cast("int")
    text = F.coalesce(_as_text(a), F.lit(""))
    at = F.when(s >= 0, s + 1).otherwise(F.greatest(F.char_length(text) + s, F.lit(0)) + 1)
    k = F.coalesce(k, F.char_length(text))
    return Val(F.substring(text, at, F.greatest(k, F.lit(0))), STRING)


operator("$substr", 3)(_substr)
operator("$substrCP", 3)(_substr)


@special("$trim")
def _trim(spec, scope: Scope) -> Val:
    a = compile_expression(spec["input"] if isinstance(spec, dict) and "input" in spec else spec[0] if isinstance(spec, list) else spec, scope)
    return Val(F.regexp_replace(F.coalesce(_as_text(a), F.lit("")), r"^[\s\x{FEFF}\x{A0}]+|[\s\x{FEFF}\x{A0}]+$", ""), STRING)


operator("$eq", 2)(lambda a, b: Val(equal(a, b), BOOL))
operator("$ne", 2)(lambda a, b: Val(~equal(a, b), BOOL))
for _name, _sign in (("$gt", ">"), ("$gte", ">="), ("$lt", "<"), ("$lte", "<=")):
    operator(_name, 2)(lambda a, b, s=_sign: Val(sure(compare(s, a, b)), BOOL))


@operator("$cmp", 2)
def _cmp(a: Val, b: Val) -> Val:
    return Val(F.when(sure(compare("<", a, b)), -1).when(sure(compare(">", a, b)), 1).otherwise(0).cast("long"), LONG)


def choose(cases: list[tuple[Column, Val]], other: Val) -> Val:
    to = shared_type([other.dtype, *(v.dtype for _, v in cases)])
    out = None
    for c, v in cases:
        out = F.when(c, coerce(v, to)) if out is None else out.when(c, coerce(v, to))
    return Val(out.otherwise(coerce(other, to)) if out is not None else coerce(other, to), to)


@special("$cond")
def _cond(spec, scope: Scope) -> Val:
    parts = [spec.get("if"), spec.get("then"), spec.get("else")] if isinstance(spec, dict) else [*spec, None, None][:3]
    test, then, other = (compile_expression(p, scope) for p in parts)
    return choose([(truthy(test), then)], other)


@operator("$ifNull")
def _if_null(*a: Val) -> Val:
    to = shared_type(v.dtype for v in a)
    return Val(F.coalesce(*(coerce(v, to) for v in a)), to)


@special("$switch")
def _switch(spec, scope: Scope) -> Val:
    cases = [(truthy(compile_expression(b["case"], scope)), compile_expression(b["then"], scope)) for b in spec.get("branches", [])]
    if "default" in spec:
        return choose(cases, compile_expression(spec["default"], scope))
    out = choose(cases, missing())
    hit = F.lit(False)
    for c, _ in cases:
        hit = hit | c
    return Val(F.when(hit, out.col).otherwise(F.raise_error(F.lit("$switch: no branch matched and there is no default")).cast(out.dtype)), out.dtype)


@operator("$and")
def _and(*a: Val) -> Val:
    out = F.lit(True)
    for v in a:
        out = out & truthy(v)
    return Val(out, BOOL)


@operator("$or")
def _or(*a: Val) -> Val:
    out = F.lit(False)
    for v in a:
        out = out | truthy(v)
    return Val(out, BOOL)


@operator("$not")
def _not(*a: Val) -> Val:
    return Val(~truthy(a[0]) if a else F.lit(True), BOOL)


@operator("$size", 1)
def _size(a: Val) -> Val:
    return Val(F.coalesce(F.when(a.col.isNotNull(), F.size(a.col)), F.lit(0)).cast("long") if a.kind == "array" else F.lit(0).cast("long"), LONG)


@operator("$arrayElemAt", 2)
def _elem_at(a: Val, i: Val) -> Val:
    if a.kind != "array":
        return missing()
    at = number(i).col.cast("int")
    return Val(F.when(at >= 0, F.get(a.col, at)).otherwise(F.try_element_at(a.col, F.when(at < 0, at))), a.dtype.elementType)


@operator("$in", 2)
def _in(x: Val, a: Val) -> Val:
    if a.kind != "array":
        return Val(F.lit(False), BOOL)
    of = a.dtype.elementType
    return Val(sure(F.exists(a.col, lambda e: equal(Val(e, of), x))), BOOL)


@operator("$concatArrays")
def _concat_arrays(*a: Val) -> Val:
    """What is no array, null too, is one element."""
    lists = [v if v.kind == "array" else Val(F.array(v.col), T.ArrayType(v.dtype)) for v in a]
    if not lists:
        return Val(F.array(), T.ArrayType(values.NULL))
    to: T.DataType = lists[0].dtype
    for v in lists[1:]:
        try:
            to = common_type(to, v.dtype)
        except SpecError:
            to = T.ArrayType(STRING)
    none = F.array(F.lit(None).cast(to.elementType))
    return Val(F.concat(*(F.coalesce(coerce(v, to), none) for v in lists)), T.ArrayType(to.elementType))


@operator("$reverseArray", 1)
def _reverse(a: Val) -> Val:
    return Val(F.reverse(a.col), a.dtype) if a.kind == "array" else a


@special("$map")
def _map(spec, scope: Scope) -> Val:
    a, name = compile_expression(spec["input"], scope), spec.get("as", "this")
    if a.kind != "array":
        return missing()
    of = a.dtype.elementType
    shape = compile_expression(spec["in"], scope.bind(**{name: Val(F.lit(None).cast(of), of)})).dtype
    return Val(F.transform(a.col, lambda x: compile_expression(spec["in"], scope.bind(**{name: Val(x, of)})).col), T.ArrayType(shape))


@special("$filter")
def _filter(spec, scope: Scope) -> Val:
    a, name = compile_expression(spec["input"], scope), spec.get("as", "this")
    if a.kind != "array":
        return missing()
    of = a.dtype.elementType
    return Val(F.filter(a.col, lambda x: truthy(compile_expression(spec["cond"], scope.bind(**{name: Val(x, of)})))), a.dtype)


@operator("$mergeObjects")
def _merge(*a: Val) -> Val:
    """The last object that is there says what a field is, null too."""
    objects = [v for v in a if isinstance(v.dtype, T.StructType)]
    names = list(dict.fromkeys(n for v in objects for n in v.dtype.names))
    return values.struct({n: _last_of([v for v in objects if n in v.dtype.names], n) for n in names})


def _last_of(objects: list[Val], name: str) -> Val:
    fields = [values.field(v, name) for v in objects]
    to = shared_type(f.dtype for f in fields)
    out = coerce(fields[0], to)
    for v, f in zip(objects[1:], fields[1:]):
        out = F.when(v.col.isNotNull(), coerce(f, to)).otherwise(out)
    return Val(out, to)


@special("$rand")
def _rand(spec, scope: Scope) -> Val:
    return Val(F.rand(), DOUBLE)


@special("$literal")
def _literal(spec, scope: Scope) -> Val:
    return literal(spec)
